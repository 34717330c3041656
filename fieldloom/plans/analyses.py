"""Registered diagnostics: each takes a table and gives a table, with a text report of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from fieldloom.operators import diagnostics as D
from fieldloom.operators.layout import embedded
from fieldloom.operators.shape import shape_vectors
from fieldloom.sources.sinks import report


@dataclass(frozen=True)
class Analysis:
    analyze: Callable[..., DataFrame]
    format_report: Callable[[DataFrame], str]


def _purity_report(result: DataFrame) -> str:
    return "\n".join(f"cluster {r.cluster}: {r.size}, {r.dominant} {r.purity:.2f}" for r in result.orderBy("cluster").collect())


def _misdetection_report(result: DataFrame) -> str:
    n, closer, rank = result.selectExpr("count(*)", "count_if(closer_to = 'pred')", "avg(nullif(gt_rank, -1))").first()
    return f"{n} misdetected, {closer} closer to the predicted class, mean rank of the true class {rank or 0:.2f}"


def _embedding_report(result: DataFrame) -> str:
    sizes = result.groupBy("cluster").count().orderBy("cluster").collect()
    return "\n".join(("noise" if r.cluster < 0 else f"cluster {r.cluster}") + f": {r['count']}" for r in sizes)


ANALYSES: dict[str, Analysis] = {
    "chroma": Analysis(D.chroma_diagnosis, report),
    "misdetect": Analysis(D.misdetections, _misdetection_report),
    "purity": Analysis(D.purity, _purity_report),
    "embed": Analysis(embedded, _embedding_report),
    "mask.shape": Analysis(shape_vectors, lambda df: f"{df.count()} masks"),
}
