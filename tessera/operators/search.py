"""Vector search: filters, exact top-k, re-ranking, context assembly."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Filters:
    """What a search is held to. ``min_score`` and ``file_pattern`` act after the top-k, the others before."""

    chunk_type: str | None = None
    feature: str | None = None
    exported_only: bool = False
    min_lines: int | None = None
    max_lines: int | None = None
    file_pattern: str | None = None
    min_score: float = 0.0

    def before(self) -> Column | None:
        """Conjunction of the given conditions; min_lines and max_lines test the start line, inclusive."""
        parts = [F.col(c) == v for c, v in (("chunk_type", self.chunk_type), ("feature", self.feature)) if v]
        parts += [F.col("exported")] if self.exported_only else []
        parts += [F.col("line") >= self.min_lines] if self.min_lines is not None else []
        parts += [F.col("line") <= self.max_lines] if self.max_lines is not None else []
        return reduce(lambda a, b: a & b, parts) if parts else None


def top_k(points: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding", where: Column | None = None, metric: str = "cosine") -> DataFrame:
    """The k best points with their score: filter, score, TakeOrderedAndProject; no shuffle of the points."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = {"cosine": S.cosine, "dot": S.dot, "euclid": lambda a, b: -S.euclidean(a, b)}.get(metric.lower(), S.cosine)(F.col(vector), q)
    kept = points if where is None else points.where(where)
    return kept.withColumn("score", score).orderBy(F.desc("score"), key).limit(k)


def valid(hits: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Scores from 0 to 1; what exceeds 1 by rounding counts as 1."""
    s = F.when((F.col("score") > 1) & (F.col("score") <= 1 + 1e-6), 1.0).otherwise(F.col("score"))
    return hits.withColumn("score", s).where(F.col("score").between(0, 1) & (F.col("score") >= min_score))


def rerank(hits: DataFrame, key: str, exported: Column, documented: Column, same_feature: Column) -> DataFrame:
    """Boosts of 0.05, 0.03 and 0.04, capped at 1."""
    boost = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    adjusted = F.least(F.col("score") + boost(exported, 0.05) + boost(documented, 0.03) + boost(same_feature, 0.04), F.lit(1.0))
    return hits.withColumn("adjusted_score", adjusted).orderBy(F.desc("adjusted_score"), F.desc("score"), key)


def documented(text: Column | str) -> Column:
    return F.ltrim(F.col(text) if isinstance(text, str) else text).rlike(r"^(/\*|//)")


def search_code(chunks: DataFrame, query: list[float], k: int = 10, filters: Filters = Filters(), context_feature: str | None = None) -> DataFrame:
    """Filter, top-k, validity, minimum score and file pattern, re-ranking."""
    hits = valid(top_k(chunks, query, k, "id", where=filters.before()), filters.min_score)
    if filters.file_pattern:
        hits = hits.where(S.glob_match("file", filters.file_pattern))
    same = F.col("feature") == context_feature if context_feature else F.lit(False)
    return rerank(hits, "id", F.col("exported"), documented("text"), same)


def context(blocks: DataFrame, order: list[Column], size: Column, most: int = 8000) -> DataFrame:
    """Blocks before the first that would exceed ``most``, with their running size."""
    running = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("running", running).where(F.col("running") <= most)


#: What a context says when nothing was found, and of results that did not fit (fixed values).
NOTHING, MORE = "No relevant code chunks found.", "... ({} more results truncated)"


def context_text(hits: DataFrame, most: int = 8000) -> str:
    """The context as one string; hits are a top-k result, so they fit on the driver."""
    rows = hits.collect()
    if not rows:
        return NOTHING
    out, total = [f"# {len(rows)} relevant code chunks\n", "\n"], 0
    for i, r in enumerate(rows, 1):
        block = f"## [{i}] {r['file']}:{r['line']} {r['name']} ({r['chunk_type']}, {r['adjusted_score']:.3f})\n{r['text']}\n\n"
        if total + len(block) > most:
            out.append(MORE.format(len(rows) - i + 1))
            break
        total += len(block)
        out.append(block)
    return "".join(out)
