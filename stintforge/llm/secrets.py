"""Secrets in text: fixed patterns, and strings that a primed compressor finds novel.

Three pattern kinds are always reported.  The method then looks at all runs of 16 or more key characters that stand
near a sensitive word, on either side.  Its measure is the marginal cost under zstandard primed with a dictionary: the
compressed size of the surrounding text with the candidate, less the size without it.  The dictionary is a fixed list
of code words and the words of the corpus that stand in most of the texts with a sensitive word; its words are shorter
than a candidate, so a key that is repeated all over the corpus does not prime it.  Words, identifiers and repeats of
their surroundings cost little; a random key costs about as many bytes as its entropy.  Candidates whose marginal
bytes a character reach ``novelty`` are reported as ``novel``, whatever characters they mix, where no pattern span
covers them.

Texts without a sensitive word, an access key's mark or a run of 16 hexadecimal digits have no span of any kind; they
are told by a built-in expression and never reach Python.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow

#: Fixed patterns and least lengths, in the order of the kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"secret|token|passw|pwd|credential|api.?key|private|bearer|auth|access.?key|signature|session|cookie|license.?key", re.IGNORECASE | re.ASCII)
#: Each sensitive word has one of these in lower case; they are looked for first, as bytes.
STEMS = ("secret", "token", "passw", "pwd", "credential", "api", "private", "bearer", "auth", "access", "signature", "session", "cookie", "license")
#: A corpus word of the dictionary, and how many of them there are.
IDENTIFIER = r"(?<![A-Za-z0-9])[A-Za-z]{3,15}(?![A-Za-z0-9])"
IDENTIFIERS = 2048
#: Marginal bytes a character from which a candidate is reported.  Of 300 planted keys of 18 to 40 characters from five
#: alphabets 296 reach it, of 300 names, paths and runs of three to five words of the texts 41 (see tests/llm).
NOVELTY = 0.9
#: Words that code around keys consists of.
DICTIONARY = (
    "import export return function class public private static const final string boolean integer float double void "
    "null true false none self this super async await lambda yield raise throw catch except finally switch default "
    "continue break while print format config configuration settings environment variable parameter argument "
    "username password passwd secret token access_key api_key apikey client_id client_secret authorization bearer "
    "signature certificate credential session cookie database connection hostname localhost endpoint service account "
    "http:// https:// www. .com .org .example application/json content-type user-agent get_value set_value to_string "
    "from_string read_file write_file open close request response header footer version release license copyright "
    "aaaaaaaaaaaaaaaa 0000000000000000 1234567890123456 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "xxxxxxxxxxxxxxxxxxxxxxxx ======================== ------------------------ ________________________ "
)
_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = {}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and not overlapping within a kind; matches that are too short are dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _COMPRESSORS:
        own = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=9)
        _COMPRESSORS[dictionary] = zstandard.ZstdCompressor(level=9, dict_data=own, write_content_size=False)
    return _COMPRESSORS[dictionary]


def marginal(text: str, start: int, end: int, dictionary: bytes, around: int = 1024) -> float:
    """Compressed bytes a character that the span adds to its surroundings."""
    left, right = text[max(0, start - around) : start], text[end : end + around]
    press = compressor(dictionary).compress
    return (len(press((left + text[start:end] + right).encode())) - len(press((left + right).encode()))) / (end - start)


def novel_spans(text: str, covered: list[tuple[int, int, str]], novelty: float, reach: int, dictionary: bytes) -> list[tuple[int, int, str, float]]:
    out: list[tuple[int, int, str, float]] = []
    if SENSITIVE.search(text) is None:
        return out
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if SENSITIVE.search(text, max(0, start - reach), start) is None and SENSITIVE.search(text, end, end + reach) is None:
            continue
        if any(a < end and start < b for a, b, _ in covered):
            continue
        cost = marginal(text, start, end, dictionary)
        if cost >= novelty:
            out.append((start, end, "novel", cost))
    return out


def sensitive(text: Column) -> Column:
    """Whether a sensitive word is in the text."""
    # a list of one, so that the text is lowered once
    stem = F.exists(F.array(F.lower(text)), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(s)) for s in STEMS]))
    return stem & text.rlike(f"(?i:{SENSITIVE.pattern})")


def needed(text: Column) -> Column:
    """What every span needs somewhere in its text, as built-in expressions say it."""
    return sensitive(text) | (F.contains(text, F.lit("AKIA")) & text.rlike("AKIA[A-Z0-9]{14}")) | text.rlike("[0-9a-f]{16}")


def identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> str:
    """The ``most`` words that stand in most texts with a sensitive word, at least two; the commonest last."""
    texts = docs.where(sensitive(F.col("text")))
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return "".join(f"{r.word} " for r in reversed(top.collect()))


def scan(docs: DataFrame, novelty: float = NOVELTY, reach: int = 256, dictionary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Return doc_id (or the columns ``keep``) and ``secrets``, an array of (kind, start, end, marginal) by start, then kind.

    Places count code points, the end is exclusive; marginal is null for pattern kinds.  A null text has none.  Rows
    pass through one by one: repeated rows and null ids stay.  ``dictionary`` is that of the corpus by default.
    """
    dictionary = identifiers(docs) + DICTIONARY if dictionary is None else dictionary
    names = [f for f in docs.schema.fields if f.name in (keep or ["doc_id"]) and f.name != "secrets"]
    primed, source = dictionary.encode(), fresh("__text", docs.columns)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text in batch.column(source).to_pylist():
            text = text or ""
            base = base_spans(text)
            spans = [(a, KINDS.index(k), b, None) for a, b, k in base] + [(a, KINDS.index(k), b, cost) for a, b, k, cost in novel_spans(text, base, novelty, reach, primed)]
            found.append([{"kind": KINDS[k], "start": a, "end": b, "marginal": cost} for a, k, b, cost in sorted(spans, key=lambda s: s[:3])])
        return pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in names], pa.array(found, kind)], [*[f.name for f in names], "secrets"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in names], "secrets array<struct<kind:string,start:bigint,end:bigint,marginal:double>>"])
    own = [F.col(f"`{f.name}`") for f in names]
    return map_arrow(docs.select(*own, F.when(needed(F.col("text")), F.col("text")).alias(source)), step, schema)


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace every found span of ``text`` by ``mark`` (overlapping spans by one); n_chars, if there, follows.

    No document goes; those without secrets stay as they are, null texts null.  Columns of any names are kept.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    state = F.aggregate(
        F.col("secrets"),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] < s["at"], s["done"]).otherwise(F.concat(s["done"], F.substring(F.col("row.text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).alias("done"),
        ),
    )
    marked = scan(docs.select(row, F.col("text")), keep=["row"]).select("row", F.when(F.size("secrets") > 0, state).alias("state"))
    text = F.when(F.col("state").isNull(), F.col("row.text")).otherwise(F.concat(F.col("state.done"), F.col("row.text").substr(F.col("state.at").cast("int") + 1, F.char_length("row.text"))))
    whole = marked.select("row", "state", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("state").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
