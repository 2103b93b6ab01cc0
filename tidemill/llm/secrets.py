"""Secret scan: known forms of secrets, and strings that a token vocabulary can't shorten."""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import text_of

#: Fixed patterns of the three base kinds, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
_CUE = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)

#: Strings that may be random: long runs of letters and digits with inner marks.
CANDIDATE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_=-]{14,})[A-Za-z0-9=]")
#: Known digests (hexadecimal of the lengths of MD5, SHA-1, SHA-2) and identifiers.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A single word of one case, tested from so many characters: of 5000 documents of sf0.1, 27 held such words of 16 to 18 characters (German
#: compounds) under the limit, none held longer ones or other strings.
WORD, LEAST_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), 20
#: Numbers, with marks between: dates, times, telephone and account numbers.
NUMBER = re.compile(r"[0-9]+(?:[/_=+-]+[0-9]+)*=*")


class Scanner:
    _open: dict = {}

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, vocabulary: str, pattern: str) -> "Scanner":
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary, pattern)
        return cls._open[vocabulary]

    def is_random(self, s: str, chars_per_token: float) -> bool:
        """Few characters a token, and no known digest or identifier, nor a number."""
        if DIGEST.fullmatch(s) or UUID.fullmatch(s) or NUMBER.fullmatch(s):
            return False
        if len(s) < LEAST_WORD and WORD.fullmatch(s):
            return False
        return len(s) < chars_per_token * len(self.encoding.encode_ordinary(s))

    def spans(self, text: str, chars_per_token: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and all spans, as (start, number of the kind, end), sorted."""
        base = []
        if _CUE.search(text):
            base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base.sort()
        more, k, covered = [], 0, 0
        for m in CANDIDATE.finditer(text):
            # what base spans leave of the candidate; spans and candidates are both in order, so each span is passed once
            at = max(m.start(), covered)
            while True:
                stop = min(base[k][0], m.end()) if k < len(base) else m.end()
                more += [(x.start(), 3, x.end()) for x in CANDIDATE.finditer(text, at, max(at, stop)) if self.is_random(x[0], chars_per_token)]
                if k == len(base) or base[k][0] >= m.end():
                    break
                covered = max(covered, base[k][2])
                at, k = max(at, covered), k + 1
        return base, sorted(base + more)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans, joined where they overlap, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, vocabulary: str, pattern: str, chars_per_token: float = 2.2) -> DataFrame:
    """Spans of secrets in every whole text, and the text without them.

    Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and redacted. Base kinds are
    matched by their fixed patterns; ``random`` adds strings of 16 or more characters (single words of letters of one case: :data:`LEAST_WORD`) with under
    ``chars_per_token`` characters a token of a tiktoken vocabulary (``vocabulary`` holds its ranks,
    ``pattern`` splits text) that are no number and no known digest or identifier; of those that overlap base spans, the parts outside are tested. Spans
    count code points, ends excluded, and are sorted by start and then kind.

    One pass in the tasks that read the table; nothing is shuffled. Null text: empty, no spans. Repeated
    or null ids: a row each. An empty table gives no rows. Other columns are ignored.
    """

    def scan(batches):
        scanner = Scanner.get(vocabulary, pattern)
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), []
            for text in texts:
                base, spans = scanner.spans(text, chars_per_token)
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), redact(text, spans) if spans else text))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "redacted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")


def redact_documents(docs: DataFrame, vocabulary: str, pattern: str, chars_per_token: float = 2.2) -> DataFrame:
    """The documents with every secret in ``text`` replaced, and ``n_chars`` counted anew; all other columns as they are.

    Null text stays null (``n_chars`` null); empty text stays. Very long texts are scanned whole. Null ids and repeated rows: a row each. An
    empty table gives no rows. Columns of any name are carried.
    """

    def scan(batches):
        scanner = Scanner.get(vocabulary, pattern)
        for batch in batches:
            texts = [t if t is None else redact(t, scanner.spans(t, chars_per_token)[1]) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(texts, pa.string())
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.withColumn("text", docs["text"].cast("string")).withColumn("n_chars", docs["n_chars"].cast("long"))
    return rows.mapInArrow(scan, rows.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("redacted")
