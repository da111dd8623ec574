"""Questionnaire definitions and the function that scores a table with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import MISSING_LIMIT, least_answers


@dataclass(frozen=True)
class Block:
    """Items sharing a prefix, with the recoding that comes before scoring."""

    prefix: str
    shift: int = 0
    reversed_items: Sequence[int] = ()
    low_plus_high: int = 0

    def items(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c.lower().startswith(self.prefix.lower())]

    def recoded(self, item: str) -> str:
        """The recoded answer as SQL text: a battery has hundreds of items,
        and one parsed text per score keeps building the plan quick."""
        out = f"(`{item}` + {self.shift})" if self.shift else f"`{item}`"
        number = item[len(self.prefix):].lstrip("_")
        if number.isdigit() and int(number) in self.reversed_items:
            out = f"({self.low_plus_high} - {out})"
        return out


@dataclass(frozen=True)
class Scale:
    """One score: all items of a block, some of them, or a sum of scores."""

    name: str
    block: str = ""
    items: Sequence[int] | None = None
    how: str = "sum"  # sum | mean | item
    sum_of: Sequence[str] = field(default_factory=tuple)


# Item blocks with their recoding.
BLOCKS = (
    Block("B039", shift=-1),
    Block("B040", shift=-1),
    Block("FC01"),
    Block("PH01", shift=-1),
    Block("ST03", reversed_items=(1, 15, 16), low_plus_high=5),
    Block("IU02"),
    Block("PS01", reversed_items=(1, 3, 8, 10, 11), low_plus_high=6),
    Block("AS01", shift=-1),
    Block("IA01", shift=-1),
    Block("ST02", reversed_items=(1, 3, 6, 7, 10, 13, 14, 16, 19), low_plus_high=5),
    Block("AD01", shift=-1, reversed_items=(9, 12), low_plus_high=3),
    Block("SD01", reversed_items=(9,), low_plus_high=6),
    Block("SD04", reversed_items=(3, 7, 8, 10), low_plus_high=6),
)

# Scores and the item numbers each one uses.
SCALES = (
    Scale("cdr", "B039"),
    Scale("cdr_flex", "B039", (1, 5)),
    Scale("cdr_effic", "B039", (2, 4, 9)),
    Scale("cdr_regulate", "B039", (10,), how="item"),
    Scale("cdr_optim", "B039", (3, 6, 8)),
    Scale("cdr_focus", "B039", (7,), how="item"),
    Scale("body", "B040"),
    Scale("foc", "FC01"),
    Scale("phq2", "PH01"),
    Scale("stai_state", "ST03"),
    Scale("ius_p", "IU02", (7, 8, 10, 11, 18, 19, 21)),
    Scale("ius_i", "IU02", (9, 12, 15, 20, 25)),
    Scale("pswq", "PS01"),
    Scale("asi3_phys", "AS01", (3, 4, 7, 8, 12, 15)),
    Scale("asi3_cog", "AS01", (2, 5, 10, 14, 16, 18)),
    Scale("asi3_soc", "AS01", (1, 6, 9, 11, 13, 17)),
    Scale("asi3", sum_of=("asi3_phys", "asi3_cog", "asi3_soc")),
    Scale("ias", "IA01"),
    Scale("stai_trait", "ST02"),
    Scale("adsk", "AD01"),
    Scale("lisd_state_lonely", "SD01", (1, 3, 4, 5, 6, 7, 10, 11, 12), how="mean"),
    Scale("lisd_state_support", "SD01", (2, 8, 9), how="mean"),
    Scale("lisd_trait_lonely", "SD04", (2, 9, 12, 13), how="mean"),
    Scale("lisd_trait_belong", "SD04", (1, 4, 5, 10, 11), how="mean"),
    Scale("lisd_trait_close", "SD04", (3, 6, 7, 8), how="mean"),
)

# Scores taken again at the middle wave.
MIDDLE_WAVE = ("asi3_phys", "asi3_cog", "asi3_soc", "asi3", "pswq", "stai_trait")


def score(
    df: DataFrame,
    scales: Sequence[Scale] = SCALES,
    blocks: Sequence[Block] = BLOCKS,
    limit: float = MISSING_LIMIT,
) -> DataFrame:
    """Add one column per scale. Items stay as answered; a scale whose block
    is not in the table is skipped."""
    by_prefix = {b.prefix: b for b in blocks}
    present = set(df.columns)
    parts: dict[str, Column] = {}  # answer counts and sums, each used several times
    made: dict[str, Column] = {}
    for s in scales:
        if s.sum_of:
            if all(p in made for p in s.sum_of):
                made[s.name] = sum((made[p] for p in s.sum_of[1:]), made[s.sum_of[0]])
            continue
        block = by_prefix[s.block]
        names = (
            block.items(df) if s.items is None else [f"{s.block}_{i:02d}" for i in s.items]
        )
        if not names or not set(names) <= present:
            continue
        answers = [block.recoded(n) for n in names]
        if s.how == "item":
            made[s.name] = F.expr(answers[0]).cast("double")
            continue
        k = len(names)
        count, total = f"_n_{s.name}", f"_sum_{s.name}"
        parts[count] = F.expr(" + ".join(f"CAST(`{n}` IS NOT NULL AS INT)" for n in names))
        parts[total] = F.expr(" + ".join(f"coalesce(CAST({a} AS DOUBLE), 0D)" for a in answers))
        per_item = F.when(F.col(count) >= least_answers(k, limit), F.col(total) / F.col(count))
        made[s.name] = per_item if s.how == "mean" else per_item * F.lit(float(k))
    return df.withColumns(parts).withColumns(made).drop(*parts)


def middle_wave_scales() -> list[Scale]:
    return [s for s in SCALES if s.name in MIDDLE_WAVE]
