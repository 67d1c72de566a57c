"""Which chunks contain a golden passage, in one narrow scan per block of passages.

A task looks for all passages of a block at once: an Aho-Corasick automaton runs over each chunk
and stops at the *anchors* of the passages, short stretches of them that few other passages
have. Where one is met, the whole passage is compared in place. Every non-blank passage has
exactly one anchor, so the result is exact and nothing comes twice. No text is shuffled, and
more passages mean more blocks with a scan each, not another plan.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlnet.functions import text
from trawlnet.functions.batches import pieces
from trawlnet.sources.scratch import materialize

BLOCK_PASSAGES = 50_000  # passages of a block, about, and
BLOCK_CHARS = 16 << 20  # characters in them: what one scan takes to the tasks
ANCHOR = 16  # characters of an anchor
STEP = 8  # characters from one possible anchor of a passage to the next
_BATCH_BYTES = 8 << 20


def anchors(passages: Sequence[str]) -> list[tuple[int, str]]:
    """Per passage, the place and the text of an anchor that as few as can be have, the first of them."""

    def possible(passage: str) -> Iterator[tuple[int, str]]:
        last = max(len(passage) - ANCHOR, 0)
        for at in (*range(0, last, STEP), last):
            yield at, passage[at : at + ANCHOR]

    common = Counter(a for p in passages for a in {a for _, a in possible(p)})
    return [min(possible(p), key=lambda x: common[x[1]]) for p in passages]


class Finder:
    """Looks for many passages in one text at a time."""

    def __init__(self, passages: Sequence[str]):
        import ahocorasick

        self.passages = passages
        met = defaultdict(list)
        for i, (at, anchor) in enumerate(anchors(passages)):
            met[anchor].append((i, at + len(anchor) - 1))
        self.automaton = ahocorasick.Automaton()
        for anchor, places in met.items():
            self.automaton.add_word(anchor, places)
        self.automaton.make_automaton()

    def __call__(self, chunk: str) -> list[int]:
        """Numbers of the passages that the text contains."""
        found: dict[int, None] = {}
        for end, places in self.automaton.iter(chunk):
            for i, before in places:
                if i not in found and end >= before and chunk.startswith(self.passages[i], end - before):
                    found[i] = None
        return list(found)


def _blocks(gold: DataFrame) -> Iterator[pa.Table]:
    """The passages that are not blank, in blocks of a bounded size, one at a time on the driver."""
    named = gold.select("query_id", "full_sentence").where(F.size(text.words("full_sentence")) > 0)
    named = materialize(named, "passages")
    size = named.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("full_sentence")).alias("chars")).first()
    n_blocks = max(-(-size["n"] // BLOCK_PASSAGES), -(-(size["chars"] or 0) // BLOCK_CHARS))
    for block in range(n_blocks):
        table = named.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).toArrow()
        if table.num_rows:
            yield table


def containing_chunks(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs (query_id, chunk_id, text_key) where the chunk contains the passage verbatim.

    A blank or NULL passage is contained in nothing, and a NULL chunk contains nothing. The
    passages are brought to the driver before the result is returned.
    """
    spark = gold.sparkSession
    names = [("query_id", gold.schema["query_id"].dataType), ("chunk_id", chunks.schema["chunk_id"].dataType)]
    schema = T.StructType([T.StructField(n, t) for n, t in [*names, ("text_key", T.StringType())]])
    rows = chunks.select("chunk_id", "chunk").where("chunk is not null")
    found = []
    for table in _blocks(gold):
        shared = spark.sparkContext.broadcast((table.column("query_id").combine_chunks(), table.column("full_sentence").to_pylist()))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, passages = shared.value
            finder = Finder(passages)
            for batch in (piece for whole in batches for piece in pieces(whole, _BATCH_BYTES)):
                row, passage, keys = [], [], []
                for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                    if met := finder(chunk):
                        passage += met
                        row += [i] * len(met)
                        keys += [hashlib.sha256(chunk.encode()).hexdigest()] * len(met)
                columns = [ids.take(pa.array(passage, pa.int64())), batch.column("chunk_id").take(pa.array(row, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.string())], names=schema.names)

        found.append(rows.mapInArrow(find, schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
