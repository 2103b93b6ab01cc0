"""Fill-in-middle forms of documents, cut at token ends that one match retains."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: A unit is a word with the white space before it, or the white space a text ends in. Nothing matched is ever given back, so no state is held for it.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
MARKERS = ("<P>", "<S>", "<M>")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
FORMS = ("plain", "spm", "psm")
_CUT = "n long, form string, prefix_chars long, middle_chars long, output string"


def checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers that can be told apart in any output: different, and none holds the first character of one but at its begin."""
    firsts = {m[:1] for m in markers}
    if len(set(markers)) < 3 or "" in markers or any(c in m[1:] for m in markers for c in firsts):
        raise ValueError("markers must differ, and hold their first characters nowhere else")
    return markers


def draws(doc_id: Column, seed: int, fim_percent: int, spm_percent: int) -> list[Column]:
    """Two numbers for the cuts and a form (of :data:`FORMS`), by the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(h[2] % 100 >= fim_percent, 0).when(h[3] % 100 < spm_percent, 1).otherwise(2)
    return [h[0].alias("h1"), h[1].alias("h2"), form.alias("form")]


def cut(text: str, h1: int, h2: int, form: int, markers: tuple[str, str, str]) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not form or not text or any(m in text for m in markers):
        return n, FORMS[0], None, None, text
    a, b = (ends[k - 1] if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    (p, s, m), prefix, middle, suffix = markers, text[:a], text[a:b], text[b:]
    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == 1 else f"{p}{prefix}{s}{suffix}{m}{middle}"
    return n, FORMS[form], a, b - a, output


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from which an output of that form was made. Markers in an output are those put there, since texts that hold one stay plain."""
    p, s, m = checked(markers)
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    middle = part(output, m, 2)
    head = part(output, m, 1)
    spm = F.concat(part(head, p, 2), middle, part(F.substring(head, len(s) + 1, 2**31 - 1), p, 1))
    psm = F.concat(part(F.substring(head, len(p) + 1, 2**31 - 1), s, 1), middle, part(head, s, 2))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def _cut_all(rows: DataFrame, kept: list[str], markers: tuple[str, str, str]) -> DataFrame:
    """``kept`` columns of rows (text, h1, h2, form, ...) and what :func:`cut` gives."""
    markers = checked(markers)
    names = [x.split()[0] for x in _CUT.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    schema = T.StructType([*(rows.schema[c] for c in kept), *T.StructType.fromDDL(_CUT)])

    def forms(batches):
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("text", "h1", "h2", "form")))
            found = list(zip(*(cut(*x, markers) for x in columns))) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, found, types)], [*kept, *names])

    return rows.mapInArrow(forms, schema)


def fill_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every whole text.

    A full match of repeated units retains the end of each, which gives their number and both cuts at once. Numbers drawn from seed and id
    choose the cuts and the form: ``plain``, ``spm`` (suffix first) or ``psm`` (prefix first). A text that is empty or holds a marker is plain.

    One pass in the tasks that read the table; nothing is shuffled, and a lost task is drawn again alike. Null text: empty. Null id: drawn as
    an empty one. Equal ids are drawn alike, a row each. Very long texts are cut whole. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text"), *draws(docs["doc_id"], seed, fim_percent, spm_percent))
    return _cut_all(rows, ["doc_id"], markers)


def fill_middle_documents(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """The documents with their texts in the form drawn; other columns, of any name, as they are. Null texts become empty; see :func:`fill_middle`."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("row"), text_of(docs).alias("text"), *draws(docs["doc_id"], seed, fim_percent, spm_percent))
    out = _cut_all(rows, ["row"], markers)
    return out.select(*[(F.col("output") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)
