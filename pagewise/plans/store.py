"""A paged store as a lazy builder over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import alibi_bias
from ..model import EngineConfig
from ..operators import attention, paging, scoring, selection


@dataclass(frozen=True)
class PagedStore:
    """Tokens (``seq_id``, ``pos``, ``head``, ``k``, ``v``) in pages. Every method returns a lazy DataFrame or a new store."""

    config: EngineConfig
    tokens: DataFrame

    @classmethod
    def of_vectors(cls, config: EngineConfig, vectors: DataFrame, seq: str | None, pos: str, vec: str = "embedding") -> PagedStore:
        rows = vectors.select((F.lit(0) if seq is None else F.col(seq)).cast("long").alias("seq_id"), F.col(pos).cast("long").alias("pos"), vec)
        return cls(config, paging.split_heads(rows, config.n_heads, config.head_dim, vec))

    def append(self, rows: DataFrame) -> PagedStore:
        """The store with ``rows`` (``seq_id``, ``ord``, ``head``, ``k``, ``v``) behind each sequence's last one."""
        new = rows.select("seq_id", "ord").distinct()
        at = paging.append(self.meta(), new, self.config.page_size).select("seq_id", "ord", "pos")
        placed = rows.join(at, ["seq_id", "ord"]).select("seq_id", "pos", "head", "k", "v")
        return replace(self, tokens=self.tokens.select("seq_id", "pos", "head", "k", "v").unionByName(placed))

    def meta(self) -> DataFrame:
        return paging.seq_meta(self.tokens.where("head = 0"), "seq_id", self.config.page_size)

    def page_table(self) -> DataFrame:
        return paging.page_table(self.meta())

    def pages(self) -> DataFrame:
        """Tokens with ``page_id`` and ``slot``."""
        p = self.config.page_size
        return self.tokens.withColumn("page_id", paging.page_of(F.col("pos"), p)).withColumn("slot", paging.slot_of(F.col("pos"), p))

    def digests(self) -> DataFrame:
        return scoring.digests(self.pages(), self.config.head_dim, ("seq_id", "page_id", "head"))

    def query(self, queries: DataFrame) -> Query:
        """``queries``: ``query_id``, ``seq_id``, ``head``, ``q``."""
        return Query(self, queries)

    def create_views(self, spark: SparkSession, prefix: str = "pw_") -> None:
        """Temporary views of every stage, for SQL."""
        for name, df in (("tokens", self.pages()), ("page_table", self.page_table()), ("seq_meta", self.meta()), ("page_digest", self.digests())):
            df.createOrReplaceTempView(prefix + name)


@dataclass(frozen=True)
class Query:
    store: PagedStore
    queries: DataFrame
    chosen: DataFrame | None = field(default=None)

    def scores(self) -> DataFrame:
        """Upper bounds for pages of the query's own sequence."""
        dim = self.store.config.head_dim
        q = scoring.few(self.queries.select("query_id", "seq_id", "head", "q"))
        score = scoring.cuboid_bound("q", "hi", "lo", dim).alias("score")
        return self.store.digests().join(q, ["seq_id", "head"]).select("query_id", "seq_id", "page_id", "head", score)

    def select(self, k: int | None = None) -> Query:
        """Limits the rows to each head's best pages with the first and the last ones; all pages within the budget."""
        c = self.store.config
        k = c.pages_wanted if k is None else k
        of = self.scores().join(self.store.meta().select("seq_id", "n_pages"), "seq_id")
        kind = selection.kind_of(F.col("page_id"), F.col("n_pages"), c.n_sink, c.n_win)
        within = F.lit(True) if c.budget is None else F.col("n_pages") <= c.budget
        marked = of.withColumn("kind", F.when(within, "all").otherwise(kind))
        best = selection.top_pages(marked.where("kind IS NULL"), k).select("query_id", "seq_id", "head", "page_id")
        kept = marked.where("kind IS NOT NULL").select("query_id", "seq_id", "head", "page_id")
        return replace(self, chosen=best.unionByName(kept))

    def attend(self, alibi: bool = False) -> DataFrame:
        """``query_id``, ``head``, ``s``, ``o`` over the rows of the chosen pages, or over all."""
        c = self.store.config
        rows = self.store.pages()
        q = self.queries if self.chosen is None else self.queries.join(self.chosen, ["query_id", "seq_id", "head"])
        on = ("seq_id", "head") if self.chosen is None else ("seq_id", "head", "page_id")
        bias = alibi_bias(F.col("head"), c.n_heads, F.col("q_pos"), F.col("pos")) if alibi else None
        return attention.states(attention.logits(q, rows, c.head_dim, bias=bias, on=on), ["query_id", "head"], c.head_dim)
