"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Place of the vocabulary file; a session may name another in this setting.
SETTING, DEFAULT = "tidebook.tokenizer.path", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are counted in slices; see ``slices``.
SLICE = 200_000


def slices(text: str, most: int = SLICE) -> Iterator[str]:
    """Cut a text before single blanks between two words, where no token can reach across.

    A stretch of ``most`` characters without such a place is cut at its end.
    """
    at = 0
    while len(text) - at > most:
        cut = at + most
        while cut > at + 1 and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut -= 1
        cut = cut if cut > at + 1 else at + most
        yield text[at:cut]
        at = cut
    yield text[at:]


def counter(path: str):
    """A function from a text to its number of tokens; null counts as 0."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= SLICE:
            return len(encode(text))
        return sum(len(encode(part)) for part in slices(text))

    return count


def token_counts(documents: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``tokens`` of each row; whole texts, null and empty ones count 0.

    The texts stay in the scan's partitions; only sizes leave them.
    """
    path = path or documents.sparkSession.conf.get(SETTING, DEFAULT)
    keep = list(keep)
    names = [f"c{i}" for i in range(len(keep))]
    rows = documents.select(F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    schema = rows.drop("text").withColumn("tokens", F.lit(0).cast("bigint")).schema

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        count = counter(path)
        for batch in batches:
            sizes = pa.array([count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], sizes], names=[*names, "tokens"])

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "tokens")
