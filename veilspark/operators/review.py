"""A second reading of rewritten pages by a language model. It only flags; nothing is changed, and a page
on which the model fails has an error instead of flags."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .finders import Ask, answer

FLAGS = ["leaks", "wrong_replacements", "inconsistent"]
SYSTEM = (
    "You check a pseudonymised page against its original. Answer with a JSON object of three lists of short strings, each naming a text and its problem: "
    "leaks (real values that still stand), wrong_replacements (values replaced that should not be, or badly), inconsistent (one value replaced in several ways). Empty lists if all is well."
)


def review(originals: DataFrame, rewritten: DataFrame, mentions: DataFrame, load: Callable[[], Ask]) -> DataFrame:
    """(doc_id, page_no, leaks, wrong_replacements, inconsistent, error), one row a page. ``load`` runs once
    in each Python worker."""
    key = ["doc_id", "page_no"]
    listed = mentions.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("", F.lit("- "), "text", F.lit(" -> "), "surrogate", F.lit(" ("), "type", F.lit(")")))), "\n").alias("expected"))
    both = originals.select(*key, F.col("text").alias("before")).join(rewritten.select(*key, F.col("text").alias("after")), key).join(listed, key, "left")

    def strings(value: object) -> list[str]:
        return [str(x) for x in (value if isinstance(value, list) else [] if value is None else [value])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for frame in frames:
            rows = []
            for doc_id, page_no, before, after, expected in frame[[*key, "before", "after", "expected"]].itertuples(index=False):
                try:
                    told = answer(ask(SYSTEM, f"ORIGINAL PAGE:\n{before}\n\nREWRITTEN PAGE:\n{after}\n\nEXPECTED REPLACEMENTS:\n{expected or '- (none)'}"))
                    rows.append((doc_id, page_no, *(strings(told.get(k)) for k in FLAGS), None))
                except Exception as error:  # noqa: BLE001 - flags only, never the run's failure
                    rows.append((doc_id, page_no, [], [], [], f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(rows, columns=[*key, *FLAGS, "error"])

    id_type = both.schema["doc_id"].dataType.simpleString()
    return both.mapInPandas(run, f"doc_id {id_type}, page_no int, leaks array<string>, wrong_replacements array<string>, inconsistent array<string>, error string")
