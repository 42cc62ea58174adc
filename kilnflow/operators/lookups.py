"""Look-ups and joins on small settings, positions and regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnflow.constants import COMPONENT_MODES
from kilnflow.operators.ordered import number_rows


def active_components(
    requests: DataFrame, components: Mapping[str, str] = COMPONENT_MODES
) -> DataFrame:
    """One row per request and component, flagged active for the request's mode.

    A component is active when its list names the mode or ``all``. The list is fixed and
    short, so it travels inside the expression; there is no join.
    """
    nodes = F.array(
        *[
            F.struct(
                F.lit(name).alias("component"),
                F.array(*[F.lit(m) for m in modes.split(",")]).alias("modes"),
            )
            for name, modes in components.items()
        ]
    )
    active = F.arrays_overlap(F.col("modes"), F.array(F.lit("all"), F.col("mode")))
    return (
        requests.select("*", F.inline(nodes))
        .withColumn("is_active", F.coalesce(active, F.lit(False)))
        .drop("modes")
    )


def dimmed_rows(
    requests: DataFrame, row_of: Mapping[str, str], components: Mapping[str, str] = COMPONENT_MODES
) -> DataFrame:
    """Display rows without an active component, one row per request and such row.

    They follow from the mode alone, so they are worked out per mode and looked up.
    """
    active = {name: set(modes.split(",")) for name, modes in components.items() if name in row_of}
    every = sorted({row_of[name] for name in active})

    def dimmed(mode: str | None) -> Column:
        lit = {row_of[name] for name, modes in active.items() if modes & {"all", mode}}
        return F.array(*[F.lit(r) for r in every if r not in lit]).cast("array<string>")

    modes = sorted(set().union(*active.values()) - {"all"})
    known = F.create_map(*[part for m in modes for part in (F.lit(m), dimmed(m))])
    return requests.select("*", F.explode(F.coalesce(known[F.col("mode")], dimmed(None))).alias("row"))


def zip_by_position(
    a: DataFrame,
    b: DataFrame,
    a_order: Sequence[str],
    b_order: Sequence[str],
    rows: int | None = None,
) -> DataFrame:
    """Pair the i-th row of one table with the i-th of the other; stop at the shorter.

    Positions are unique, so the join has no skew.
    """
    left = number_rows(a, [], a_order, "position", rows)
    right = number_rows(b, [], b_order, "position", rows)
    return left.join(right, "position")


def apply_overrides(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """An override replaces the whole entry of its key; new keys are added."""
    fields = [c for c in base.columns if c != key]
    entries = base.select(key, F.struct(*fields).alias("_base"))
    replacing = over.select(key, F.struct(*fields).alias("_over"))
    chosen = F.coalesce(F.col("_over"), F.col("_base"))
    return (
        entries.join(replacing, key, "full")
        .withColumn("_entry", chosen)
        .select(key, *[F.col(f"_entry.{f}").alias(f) for f in fields])
    )


def random_pick(prompts: DataFrame, seed: int = 42, key: str = "mode") -> DataFrame:
    """One prompt per mode, uniform and repeatable: the smallest seeded digest wins.

    ``prompt_id`` is a whole number. The first 60 bits of the digest and the id make one number,
    whose minimum a hash aggregate keeps; only the texts of the ids it gives are fetched.
    Of several texts of such an id the least is taken.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("prompt_id").cast("string")))
    high = F.conv(F.substring(draw, 1, 15), 16, 10).cast("decimal(19,0)")
    shift, turn = (F.lit(str(1 << n)).cast("decimal(20,0)") for n in (63, 64))
    lot = (high * turn + (F.col("prompt_id").cast("decimal(20,0)") + shift)).cast("decimal(38,0)")
    least = prompts.groupBy(key).agg(F.min(lot).alias("_lot"))
    won = least.select(
        F.col(key).alias("_key"), ((F.col("_lot") % turn) - shift).cast("long").alias("_id")
    )
    held = prompts.join(won, F.col(key).eqNullSafe(F.col("_key")) & (F.col("prompt_id") == F.col("_id")))
    return held.groupBy(key, "prompt_id").agg(F.min("text").alias("text"))


def pick_for_modes(requests: DataFrame, picks: DataFrame, default: str = "text2img") -> DataFrame:
    """The pick of each request's mode, or of the default mode when it has none."""
    chosen = picks.select("mode", F.struct("prompt_id", "text").alias("_pick"))
    fallback = chosen.where(F.col("mode") == default).agg(F.first("_pick")).scalar()
    return (
        requests.join(chosen, "mode", "left")
        .withColumn("_pick", F.coalesce("_pick", fallback))
        .select(*requests.columns, "_pick.*")
    )
