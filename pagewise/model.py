"""Configuration and schemas of paged vector data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class EngineConfig:
    """Layout and budget of a paged store.

    ``topk`` None means half the budget; 0 is kept as it is. ``budget`` None
    means unlimited, as a negative one does.
    """

    n_heads: int = 4
    head_dim: int = 16
    page_size: int = 16
    budget: int | None = None
    topk: int | None = None
    n_sink: int = 2
    n_win: int = 2
    offload_ratio: int = 2
    n_unlimited_layers: int = 0
    n_reuse_layers: int = 0
    group_size: int | None = None

    def __post_init__(self):
        if self.budget is not None and self.budget < 0:
            object.__setattr__(self, "budget", None)
        if self.page_size < 1 or self.n_heads < 1 or self.head_dim < 1:
            raise ValueError("page_size, n_heads and head_dim must be positive")
        if self.n_win < 2:
            raise ValueError("a window has 2 pages at least")
        if self.group_size is not None and self.n_heads % self.group_size:
            raise ValueError("group_size must divide n_heads")
        if self.budget is not None and not self.pages_wanted < self.budget - self.n_sink - self.n_win + 1:
            raise ValueError("top-k, sink and window pages must fit the budget")

    @property
    def pages_wanted(self) -> int:
        if self.topk is not None:
            return self.topk
        return min((self.budget or 0) // 2, max(0, (self.budget or 0) - self.n_sink - self.n_win))


def _s(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


LONG, INT, DOUBLE, STR, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
FLOATS, DOUBLES, STRINGS = T.ArrayType(T.FloatType()), T.ArrayType(DOUBLE), T.ArrayType(STR)

TOKENS = _s(seq_id=LONG, pos=LONG, head=INT, k=DOUBLES, v=DOUBLES)
PAGE_TABLE = _s(seq_id=LONG, page_ord=LONG, pool_page_id=LONG)
SEQ_META = _s(seq_id=LONG, n_rows=LONG, n_pages=LONG, last_page_len=LONG)
PAGE_DIGEST = _s(seq_id=LONG, page_id=LONG, head=INT, hi=DOUBLES, lo=DOUBLES)
RESIDENCY = _s(layer=INT, head=INT, slot=INT, page_id=LONG, n_valid=INT, changed=BOOL)
SELECTION = _s(query_id=LONG, head=INT, rank=INT, page_id=LONG, score=DOUBLE)
ATTN_STATE = _s(query_id=LONG, head=INT, part=LONG, s=DOUBLE, v=DOUBLES)
LAYER_POLICY = _s(layer=INT, budget=INT, topk=INT)
PROB_ROWS = _s(row_id=LONG, token_id=INT, p=DOUBLE)
EXAMPLE = _s(input=STR, context=STR, answers=STRINGS, length=INT, dataset=STR, language=STR, all_classes=STRINGS, _id=STR)
PREDICTION = _s(length=INT, token_length=INT, pred=STR, answers=STRINGS, all_classes=STRINGS)
MESSAGE = _s(conv_id=LONG, turn=LONG, role=STR, text=STR)
