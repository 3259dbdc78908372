"""The offline feature build as one fitted flow.

``FeatureFlow(steps).fit(train)`` fits encoders, imputers and scalers on train
in as few passes as their order allows, ``apply`` runs them on any frame, and
``save`` / ``load`` keep them as one folder.

Every step names the columns it reads and writes (patterns such as
``game_genres_*`` too).  Steps that touch no column of an earlier step still to
be fitted form a level and are fitted on the same frame: one aggregate for
all their sums and extremes, one for all their label counts, one quantile
selection for all their medians.  Only modes, per-group medians and power
exponents have passes of their own.  The frame is staged at the start and after
levels that joined something, before the next fit that reads rows; else a level
is a projection of the stage.  A stage holds the columns that steps still to be
fitted read, so what only ``apply`` gives is never computed by a fit.

Nulls: label lists that are null are empty, a null category is ``Unknown`` to
the one-hot step and no label to the others; statistics ignore nulls, a column
without any value is left as it is.  An empty train frame fits empty label
lists.  Labels name output columns, so a step with over ``MAX_LABELS`` of them
is refused, never cut (encode such a column through C3 / C11).
"""

from __future__ import annotations

import json
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.functions.clean import UNKNOWN
from ludex.operators.encode import Fitted, MultiLabel, OneHot
from ludex.operators.impute import GroupMedianFill, ModeFill
from ludex.operators.ordered import exact_quantiles, small_groups
from ludex.operators.profile import user_profile
from ludex.operators.scale import YeoJohnson
from ludex.session import cut_lineage, drop_stage

MAX_LABELS = 10_000


def columns(df: DataFrame, names: list[str]) -> list[str]:
    """The frame's columns that match one of the names or patterns, in the frame's order."""
    return [c for c in df.columns if any(fnmatchcase(c, n) for n in names)]


def _meet(a: list[str], b: list[str]) -> bool:
    return any(fnmatchcase(x, y) or fnmatchcase(y, x) for x in a for y in b)


class Step(Fitted):
    """A step of the flow: ``state`` holds its parameters and what was fitted, as JSON values."""

    joins = False                                     # whether ``apply`` joins (then the frame is staged after it)
    looks = True                                      # whether fitting reads the rows

    def reads(self) -> list[str]:
        return self.state["cols"]

    def writes(self) -> list[str]:
        return self.reads()

    def sums(self, df: DataFrame) -> dict[str, Column]:
        """Named aggregates wanted of the frame."""
        return {}

    def labels(self) -> tuple[str, bool] | None:
        """(column, whether it holds lists) whose distinct labels are wanted."""
        return None

    def medians(self) -> dict[str, Column]:
        """Named columns whose medians are wanted."""
        return {}

    def take(self, got: dict) -> None:
        """Keep the answers: the aggregates and medians by name, the sorted labels under ``labels``."""

    def fit_on(self, df: DataFrame) -> None:
        """A pass of the step's own."""

    def save_tables(self, path: str) -> None:
        """Write what the step keeps as tables, if anything."""

    def load_tables(self, spark: SparkSession, path: str) -> None:
        """Find those tables again."""

    def apply(self, df: DataFrame) -> DataFrame:
        raise TypeError("a step defines apply")


class OneHotStep(Step):
    """One 0/1 column a train category; ``Unknown`` for any other value and null."""

    def __init__(self, col: str):
        super().__init__(cols=[col])

    def writes(self):
        return [f"{self.state['cols'][0]}_*"]

    def labels(self):
        return self.state["cols"][0], False

    def take(self, got):
        self.state["labels"] = got["labels"]

    def apply(self, df):
        cats = self.state["labels"]
        return OneHot(col=self.state["cols"][0], categories=cats if UNKNOWN in cats else [*cats, UNKNOWN], unknown=UNKNOWN).apply(df, keep=True)


class MultiLabelStep(Step):
    """One 0/1 column a train label, and one for unseen labels."""

    def __init__(self, col: str, prefix: str):
        super().__init__(cols=[col], prefix=prefix)

    def writes(self):
        return [f"{self.state['prefix']}_*"]

    def labels(self):
        return self.state["cols"][0], True

    def take(self, got):
        self.state["labels"] = got["labels"]

    def apply(self, df):
        known = self.state["labels"]
        return MultiLabel(col=self.state["cols"][0], prefix=self.state["prefix"], known=known, classes=sorted({*known, UNKNOWN}),
                          unknown=True).apply(df, keep=True)


class Derive(Step):
    """A column from an SQL expression over ``cols``."""

    looks = False

    def __init__(self, out: str, sql: str, cols: list[str]):
        super().__init__(cols=cols, out=out, sql=sql)

    def writes(self):
        return [self.state["out"]]

    def apply(self, df):
        return df.withColumn(self.state["out"], F.expr(self.state["sql"]))


class UserMeans(Step):
    """The means of a user's rows of the same frame, for named columns and all columns of the patterns."""

    joins, looks = True, False

    def __init__(self, user: str, names: dict[str, str], patterns: list[str], prefix: str = "user_preference_"):
        super().__init__(cols=[*names, *patterns], user=user, names=names, prefix=prefix)

    def reads(self):
        return [self.state["user"], *self.state["cols"]]

    def writes(self):
        return [f"{self.state['prefix']}*"]

    def fit_on(self, df):
        self.state["found"] = columns(df, self.state["cols"])          # apply gives the train frame's columns

    def apply(self, df):
        s = self.state
        return user_profile(df, s["user"], s["found"], s["prefix"], s["names"])


class DropConstant(Step):
    """Drop the columns that hold at most one value in train (``zero``: that are never set)."""

    def __init__(self, cols: list[str], zero: bool = False):
        super().__init__(cols=cols, zero=zero)

    def sums(self, df):
        test = (lambda c: F.max(c) == 0) if self.state["zero"] else (lambda c: F.min(c) == F.max(c))
        return {c: F.coalesce(test(F.col(f"`{c}`")), F.lit(True)) for c in columns(df, self.state["cols"])}

    def take(self, got):
        self.state["dropped"] = [c for c, flat in got.items() if flat]

    def apply(self, df):
        return df.drop(*self.state["dropped"])


class MedianStep(Step):
    """Nulls become the train median."""

    def __init__(self, cols: list[str]):
        super().__init__(cols=cols)

    def medians(self):
        return {c: F.col(c) for c in self.state["cols"]}

    def take(self, got):
        self.state["fills"] = got

    def apply(self, df):
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in self.state["fills"].items() if m is not None})


class FlagMedianStep(Step):
    """I4, one flag of it: nulls of rows with the flag set become the median of the train rows with it."""

    def __init__(self, cols: list[str], flag: str):
        super().__init__(cols=cols, flag=flag)

    def reads(self):
        return [*self.state["cols"], self.state["flag"]]

    def writes(self):
        return self.state["cols"]

    def medians(self):
        return {c: F.when(F.col(f"`{self.state['flag']}`") > 0, F.col(c)) for c in self.state["cols"]}

    def take(self, got):
        self.state["fills"] = got

    def apply(self, df):
        on = F.col(f"`{self.state['flag']}`") > 0
        return df.withColumns({c: F.coalesce(F.col(c), F.when(on, F.lit(m))) for c, m in self.state["fills"].items() if m is not None})


class FlagMediansStep(Step):
    """I4: ``FlagMedianStep`` for every column of a pattern, in the frame's order.

    The medians of a flag need the fills of those before, so each flag is a selection of its own."""

    def __init__(self, cols: list[str], flags: str):
        super().__init__(cols=cols, flags=flags)

    def reads(self):
        return [*self.state["cols"], self.state["flags"]]

    def writes(self):
        return self.state["cols"]

    def fit_on(self, df):
        self.state["steps"] = []
        for flag in columns(df, [self.state["flags"]]):
            step = FlagMedianStep(self.state["cols"], flag)
            step.take(select_medians(df, step.medians()))
            df = step.apply(df)
            self.state["steps"].append([flag, step.state["fills"]])

    def apply(self, df):
        for flag, fills in self.state["steps"]:
            step = FlagMedianStep(self.state["cols"], flag)
            step.take(fills)
            df = step.apply(df)
        return df


class ModeStep(Step):
    """Nulls become the most frequent train value (ties: the smallest)."""

    def __init__(self, cols: list[str]):
        super().__init__(cols=cols)

    def fit_on(self, df):
        self.state["modes"] = ModeFill.fit(df, self.state["cols"]).state["modes"]

    def apply(self, df):
        return ModeFill(cols=self.state["cols"], modes=self.state["modes"]).apply(df)


class GroupMedianStep(Step):
    """Nulls become the median of the row's group, else the median of all rows.  The groups stay a table."""

    joins = True

    def __init__(self, cols: list[str], by: str):
        super().__init__(cols=cols, by=by)

    def reads(self):
        return [*self.state["cols"], self.state["by"]]

    def writes(self):
        return self.state["cols"]

    def fit_on(self, df):
        self.fill = GroupMedianFill.fit(df, self.state["cols"], self.state["by"])

    def apply(self, df):
        return self.fill.apply(df)

    def save_tables(self, path):
        self.fill.table().write.mode("overwrite").parquet(path)
        self.state["fill"] = self.fill.state

    def load_tables(self, spark, path):
        self.fill = GroupMedianFill(**self.state["fill"])
        self.fill._table = spark.read.parquet(path)


class ScaleStep(Step):
    """N1 (``minmax``) or N2: (x - low) / width; a column that an earlier step dropped is passed over."""

    def __init__(self, cols: list[str], minmax: bool = False):
        super().__init__(cols=cols, minmax=minmax)

    def sums(self, df):
        lo, hi = (F.min, F.max) if self.state["minmax"] else (F.avg, F.stddev_pop)
        return {f"{c}|{n}": f(F.col(c).cast("double")) for c in columns(df, self.state["cols"]) for n, f in (("lo", lo), ("hi", hi))}

    def take(self, got):
        self.state["scale"] = {}
        for name in got:
            c, which = name.rsplit("|", 1)
            lo, hi = got[f"{c}|lo"], got[f"{c}|hi"]
            if which == "lo" and lo is not None:
                self.state["scale"][c] = [lo, ((hi - lo) if self.state["minmax"] else hi) or 1.0]

    def apply(self, df):
        return df.withColumns({c: (F.col(c) - F.lit(lo)) / F.lit(width) for c, (lo, width) in self.state["scale"].items()})


class PowerStep(Step):
    """N5 + N3 + N4: the Yeo-Johnson transform of the columns whose train skewness exceeds ``threshold``."""

    def __init__(self, cols: list[str], threshold: float = 1.0):
        super().__init__(cols=cols, threshold=threshold)

    def sums(self, df):
        out = {}
        for c in columns(df, self.state["cols"]):                        # bias-corrected, as ``profile.skew_table``
            n = F.count(F.col(c)).cast("double")
            out[c] = F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))
        return out

    def take(self, got):
        self.state["skewed"] = [c for c, v in got.items() if v is not None and abs(v) > self.state["threshold"]]

    def fit_on(self, df):
        cols = self.state["skewed"]
        self.state["lambdas"] = [float(x) for x in YeoJohnson.fit(df.select(*cols), cols).state["lambdas"]] if cols else []

    def apply(self, df):
        return YeoJohnson(cols=self.state["skewed"], lambdas=self.state["lambdas"]).apply(df) if self.state["skewed"] else df


def select_medians(df: DataFrame, wanted: dict[str, Column]) -> dict[str, float | None]:
    """Medians of several expressions in one selection."""
    names = [f"m{i}" for i in range(len(wanted))]
    part = df.select(*[c.cast("double").alias(n) for n, c in zip(names, wanted.values())]).where(F.coalesce(*names).isNotNull())
    r = exact_quantiles(part, names, [0.5], bounded=small_groups(part)).first()
    return {k: r[n][0] if r is not None and r[n] else None for k, n in zip(wanted, names)}


class FeatureFlow:
    """Steps fitted together.  ``levels`` tells which steps (by place) shared their passes, ``passes`` how many
    joint passes over the frame there were."""

    KINDS = {k.__name__: k for k in (OneHotStep, MultiLabelStep, Derive, UserMeans, DropConstant, MedianStep, FlagMedianStep, FlagMediansStep,
                                     ModeStep, GroupMedianStep, ScaleStep, PowerStep)}

    def __init__(self, steps: list[Step]):
        self.steps, self.levels, self.passes = steps, [], 0

    def _ready(self, left: list[int]) -> list[int]:
        """The steps that touch nothing of an earlier one that is not fitted yet."""
        level = []
        for at, i in enumerate(left):
            s = self.steps[i]
            if not any(_meet(e.writes(), s.reads() + s.writes()) or _meet(e.reads(), s.writes())
                       for e in (self.steps[j] for j in left[:at])):
                level.append(i)
        return level

    def _stage(self, df: DataFrame, left: list[int]) -> DataFrame:
        """The frame written once, with the columns that the steps still to be fitted read."""
        kept = columns(df, [c for i in left for c in self.steps[i].reads()])
        return cut_lineage(df.select(*[F.col(f"`{c}`") for c in kept or df.columns]))

    def fit(self, train: DataFrame, staged: bool = False) -> "FeatureFlow":
        """``staged``: the frame is a written one (or rows of one), so it is read as it is."""
        left, joined = list(range(len(self.steps))), False
        stages = [] if staged else [self._stage(train, left)]
        df = train if staged else stages[0]
        self.levels, self.passes = [], 0
        while left:
            level = self._ready(left)
            if joined and any(self.steps[i].looks for i in level):
                stages.append(self._stage(df, left))
                df, joined = stages[-1], False
            self._fit_level(df, level)
            for i in level:
                df = self.steps[i].apply(df)
            left = [i for i in left if i not in level]
            self.levels.append(level)
            joined = joined or any(self.steps[i].joins for i in level)
        drop_stage(*stages)
        return self

    def _fit_level(self, df: DataFrame, level: list[int]) -> None:
        got: dict[int, dict] = {i: {} for i in level}
        sums = [(i, n, c) for i in level for n, c in self.steps[i].sums(df).items()]
        if sums:
            r = df.agg(*[c.alias(f"s{k}") for k, (_, _, c) in enumerate(sums)]).first()
            self.passes += 1
            for k, (i, n, _) in enumerate(sums):
                got[i][n] = r[k]
        asked = {i: self.steps[i].labels() for i in level if self.steps[i].labels()}
        if asked:
            for i in asked:
                got[i]["labels"] = []
            one = [df.select(F.lit(i).alias("step"), (F.explode(F.col(c).cast("array<string>")) if many else F.col(c).cast("string")).alias("label"))
                   for i, (c, many) in asked.items()]
            found = reduce(DataFrame.union, one).filter("label IS NOT NULL").distinct()
            rows = found.limit(MAX_LABELS * len(asked) + 1).collect()    # bounded; over it the fit is refused
            self.passes += 1
            for r in rows:
                got[r["step"]]["labels"].append(r["label"])
            for i, (c, _) in asked.items():
                if len(got[i]["labels"]) > MAX_LABELS or len(rows) > MAX_LABELS * len(asked):
                    raise ValueError(f"{c}: over {MAX_LABELS} labels cannot name columns")
                got[i]["labels"].sort()
        medians = {(i, n): c for i in level for n, c in self.steps[i].medians().items()}
        if medians:
            for (i, n), m in select_medians(df, medians).items():
                got[i][n] = m
            self.passes += 1
        for i in level:
            self.steps[i].take(got[i])
            self.steps[i].fit_on(df)

    def apply(self, df: DataFrame) -> DataFrame:
        user = next((s.state["user"] for s in self.steps if isinstance(s, UserMeans)), None)
        if user and small_groups(df, [user]):
            df = df.repartition(user)           # rows meet their user before they are encoded: no encoded row is shuffled
        for i in (i for level in self.levels for i in level):
            df = self.steps[i].apply(df)
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        """One table of the steps' states in ``path``/flow, written last, beside the tables that steps keep."""
        for i, step in enumerate(self.steps):
            step.save_tables(f"{path}/{i:03d}")
        rows = [(i, type(step).__name__, json.dumps(step.state), json.dumps(self.levels)) for i, step in enumerate(self.steps)]
        spark.createDataFrame(rows, "step int, kind string, state string, levels string").coalesce(1).write.mode("overwrite").parquet(f"{path}/flow")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureFlow":
        flow = cls([])
        for r in sorted(spark.read.parquet(f"{path}/flow").collect()):
            step = cls.KINDS[r["kind"]].__new__(cls.KINDS[r["kind"]])
            step.state = json.loads(r["state"])
            step.load_tables(spark, f"{path}/{r['step']:03d}")
            flow.steps.append(step)
            flow.levels = json.loads(r["levels"])
        return flow
