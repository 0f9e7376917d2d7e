"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded as it is.  A longer one is encoded in chunks that overlap; each chunk
gives its tokens' offsets.  Two neighbouring chunks are spliced at a stable common boundary: a place in the overlap
where a token ends and the next begins in both, and where the vocabulary's splitting provably starts afresh (a
letter or digit of ASCII followed by a space or line break: no split can cover both, so what stands left of the place
has no effect right of it, and the reverse).  Where the overlap holds no such place it is widened, at last to the
rest of the text, so the count is always exact; a chunk is held once, so memory follows the chunk unless a text has
no such place at all.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import map_arrow

STABLE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
CHUNK, OVERLAP = 1 << 16, 512


def chunked_count(text: str, library, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text, from overlapping chunks."""
    total, begin, n = 0, 0, len(text)
    while True:
        end = min(n, begin + chunk)
        lap = overlap
        while True:
            here = library.encode(text[begin:end], add_special_tokens=False)
            if end >= n:
                return total + len(here.ids)
            low = max(begin + 1, end - lap)
            there = library.encode(text[low : min(n, end + lap)], add_special_tokens=False)
            # a boundary: no token covers it, on either side of it
            left = {begin + b: i + 1 for i, (_, b) in enumerate(here.offsets)}
            starts = {begin + a for a, _ in here.offsets}
            right = {low + a for a, _ in there.offsets} & {low + b for _, b in there.offsets}
            places = [m.start() for m in STABLE.finditer(text, low, end) if m.start() > low and m.start() in right and m.start() in left and m.start() in starts]
            if places:
                total, begin = total + left[places[-1]], places[-1]
                break
            lap *= 4
            end = min(n, end + lap)


def count(docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """Return doc_id, n_bytes, n_tokens, over_limit for every row; a null text counts as empty (0 bytes, 0 tokens).

    Ids are passed through as they are, null or repeated; other columns are ignored.
    """
    place = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(place)
        texts = batch.column("text").to_pylist()
        counts = [len(own.ids(t)) if len(t) <= chunk else chunked_count(t, own.library, chunk) for t in texts]
        n = pa.array(counts, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n, pa.array([x > limit for x in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return map_arrow(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")), step, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
