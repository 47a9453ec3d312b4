"""Which of many needles does each text hold: one scan with an Aho-Corasick automaton in every worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame


def holding(texts: DataFrame, needles: DataFrame, id_col: str, text_col: str, needle_id: str, needle_col: str, most: int = 100_000) -> DataFrame:
    """(needle_id, id_col) where the text contains the needle.

    Each block of at most `most` needles is broadcast and costs a scan of the texts; nothing is shuffled.
    Null texts and null needles match nothing; the empty needle is in every text that is not null.
    """
    kinds = dict(needles.dtypes)[needle_id], dict(texts.dtypes)[id_col]

    def scan(rows: list) -> DataFrame:
        ids: dict[str, list] = {}
        for r in rows:
            ids.setdefault(r[1], []).append(r[0])
        sent = texts.sparkSession.sparkContext.broadcast(ids)
        kind = pa.string() if kinds[0] == "string" else pa.int64()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for n in sent.value:
                if n:
                    automaton.add_word(n, n)
            automaton.make_automaton()
            for batch in batches:
                place, found = [], []
                for k, value in enumerate(batch.column(text_col)):  # one text of the batch at a time is a Python string
                    if (text := value.as_py()) is None:
                        continue
                    held = {n for _, n in automaton.iter(text)} if len(automaton) else set()
                    for n in held | ({""} & sent.value.keys()):
                        found += sent.value[n]
                        place += [k] * len(sent.value[n])
                yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column(id_col).take(pa.array(place, pa.int32()))], [needle_id, id_col])

        return texts.select(id_col, text_col).mapInArrow(run, f"`{needle_id}` {'string' if kinds[0] == 'string' else 'bigint'}, `{id_col}` {kinds[1]}")

    rows = needles.select(needle_id, needle_col).where(f"`{needle_col}` is not null").toLocalIterator()
    return reduce(DataFrame.unionByName, [scan(list(block)) for block in batched(rows, most)] or [scan([])])
