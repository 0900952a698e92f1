"""Row identity: how the rows of a version get ids that last from version to version."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.canon import CanonConfig
from palimpsest.functions.similarity import SimConfig
from palimpsest.operators.matching import ORD, match_versions
from palimpsest.plans.schema import RID, quoted

Keep = Callable[[DataFrame], DataFrame]
PROVENANCE = T.StructType([T.StructField(RID, T.StringType()), T.StructField("method", T.StringType()), T.StructField("confidence", T.DoubleType())])


def normalize_keys(keys: str | Sequence[str]) -> list[str]:
    out = [keys] if isinstance(keys, str) else list(keys)
    if not out:
        raise ValueError("a primary key needs a column")
    if len(set(out)) < len(out):
        raise ValueError(f"key columns repeat: {out}")
    return out


def key_text(keys: Sequence[str]) -> Column:
    """The key as text, null if a part is null; several columns with their lengths, so that no two keys can look alike."""
    parts = [quoted(k).cast("string") for k in keys]
    if len(parts) == 1:
        return parts[0]
    parts = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.concat(parts[0], *[x for p in parts[1:] for x in (F.lit("\x1f"), p)])


def check_key_columns(df: DataFrame, keys: Sequence[str]) -> None:
    """KeyError for a missing column, ValueError for a type that cannot be a key."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"key columns not found: {missing}")
    bad = [k for k in keys if any(x in df.schema[k].dataType.simpleString() for x in ("map<", "variant"))]
    if bad:
        raise ValueError(f"columns of this type cannot be a key: {bad}")


def check_ids(n_null: int, twice: str | None, what: str = "row ids") -> None:
    """ValueError if an id is null or repeats."""
    if n_null:
        raise ValueError(f"null in {what}")
    if twice is not None:
        raise ValueError(f"{what} repeat, for example {twice!r}")


def id_problems(df: DataFrame) -> tuple[int, int, str | None]:
    """(rows, rows without id, an id that repeats) of a frame with __rid__, whose ids alone are shuffled."""
    groups = df.groupBy(RID).agg(F.count("*").alias("n"))
    null, twice = F.sum(F.when(F.col(RID).isNull(), F.col("n"))), F.max(F.when(F.col("n") > 1, F.col(RID)))
    row = groups.agg(F.sum("n").alias("n"), null.alias("null"), twice.alias("twice")).first()
    return row["n"] or 0, row["null"] or 0, row["twice"]


def compute_row_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with __rid__ from its key. KeyError for a missing column; ValueError for a null or repeated key."""
    check_key_columns(df, keys)
    out = df.select(key_text(keys).alias(RID), *[quoted(c) for c in df.columns])
    check_ids(*id_problems(out)[1:], f"key columns {list(keys)}")
    return out


class IdentityStrategy(ABC):
    """Subclass, give `strategy` a name and call `register` to use an own strategy."""

    strategy = ""

    @property
    def user_keys(self) -> list[str] | None:
        return None

    @property
    def requires_parent(self) -> bool:
        return False

    @abstractmethod
    def assign(self, df: DataFrame, parent: DataFrame | None, version: int, keep: Keep) -> tuple[DataFrame, DataFrame | None]:
        """(df with __rid__, provenance or None). keep stores a frame once and returns the stored one.

        The commit itself refuses ids that are null or repeat, in the job that compares the versions.
        """

    @abstractmethod
    def to_config(self) -> dict: ...

    @classmethod
    def from_config(cls, cfg: dict) -> IdentityStrategy:
        return cls(**{k: v for k, v in cfg.items() if k != "strategy"})


class PrimaryKeyIdentity(IdentityStrategy):
    strategy = "primary_key"

    def __init__(self, keys: str | Sequence[str]):
        self.keys = normalize_keys(keys)

    @property
    def user_keys(self) -> list[str]:
        return list(self.keys)

    def assign(self, df, parent, version, keep):
        check_key_columns(df, self.keys)
        return df.select(key_text(self.keys).alias(RID), *[quoted(c) for c in df.columns]), None

    def to_config(self) -> dict:
        return {"strategy": self.strategy, "keys": self.keys}


class ContentMatchIdentity(IdentityStrategy):
    """Ids recovered from content: exact matches, then similar rows inside blocks; the rest get fresh ids."""

    strategy = "content_match"

    def __init__(
        self,
        *,
        compare_on: Sequence[str] | None = None,
        block_on: Sequence[str] | None = None,
        exact_only: bool = False,
        row_threshold: float = 0.6,
        num_rel_tol: float = 0.05,
        round_decimals: int | None = 6,
        case_insensitive: bool = False,
        strip_strings: bool = True,
        string_soft: bool = True,
        max_block_pairs: int = 2_000_000,
    ):
        self.compare_on = list(compare_on) if compare_on else None
        self.block_on = list(block_on) if block_on else None
        self.exact_only = exact_only
        self.canon = CanonConfig(round_decimals, case_insensitive, strip_strings)
        self.sim = SimConfig(row_threshold, num_rel_tol, string_soft)
        self.max_block_pairs = max_block_pairs

    @property
    def requires_parent(self) -> bool:
        return True

    def assign(self, df, parent, version, keep):
        ordinal = F.monotonically_increasing_id()
        fresh = lambda n: F.concat(F.lit(f"{version}."), F.lower(F.hex(n)))  # noqa: E731, short, and neighbours are alike: it packs well
        if parent is None:
            out = df.withColumn(RID, fresh(ordinal))
            return out, out.select(RID, F.lit("insert").alias("method"), F.lit(None).cast("double").alias("confidence"))
        # The ordinal is written down once: recomputed, it could come out otherwise.
        new = keep(df.withColumn(ORD, ordinal))
        found = match_versions(
            new, parent, compare_on=self.compare_on, block_on=self.block_on, exact_only=self.exact_only,
            canon=self.canon, sim=self.sim, max_block_pairs=self.max_block_pairs, keep=keep,
        ).matches
        out = new.join(found.select(ORD, RID), ORD, "left").withColumn(RID, F.coalesce(RID, fresh(F.col(ORD)))).drop(ORD)
        said = new.select(ORD).join(found, ORD, "left")
        return out, said.select(F.coalesce(RID, fresh(F.col(ORD))).alias(RID), F.coalesce("method", F.lit("insert")).alias("method"), "confidence")

    def to_config(self) -> dict:
        return {
            "strategy": self.strategy, "compare_on": self.compare_on, "block_on": self.block_on, "exact_only": self.exact_only,
            "row_threshold": self.sim.row_threshold, "num_rel_tol": self.sim.num_rel_tol, "round_decimals": self.canon.round_decimals,
            "case_insensitive": self.canon.case_insensitive, "strip_strings": self.canon.strip_strings, "string_soft": self.sim.string_soft,
            "max_block_pairs": self.max_block_pairs,
        }


_KNOWN: dict[str, type[IdentityStrategy]] = {}


def register(kind: type[IdentityStrategy]) -> type[IdentityStrategy]:
    _KNOWN[kind.strategy] = kind
    return kind


register(PrimaryKeyIdentity)
register(ContentMatchIdentity)


def make_identity(cfg: dict) -> IdentityStrategy:
    if cfg.get("strategy") not in _KNOWN:
        raise ValueError(f"unknown identity strategy: {cfg.get('strategy')!r}")
    return _KNOWN[cfg["strategy"]].from_config(cfg)
