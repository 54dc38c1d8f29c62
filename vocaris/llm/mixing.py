"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target is its share of all words by weight, at most ``cap`` times the words it has; what
a capped source can't use is shared again by weight until no target is above its cap. A document of a
source with target / size = r is taken floor(r) times for sure and once more with probability
p = r - floor(r), but not independently.

About ``block`` documents of a source, by a hash of the row, are folded together, the largest first. All
have one p. A document of size s is paired with the rest of its block, of size t together; words of
expectation move between the two until one side is integral:

    a = min(s (1 - p), t p) words to the document, with probability b / (a + b), or
    b = min(s p, t (1 - p)) words from it, with probability a / (a + b).

The rest gives or takes by the same change of p for each, so that it keeps one p, which the next smaller
document meets. Every document's expectation stays as it is, and so does the sum of s p. Mostly the
document is decided and the rest goes on; where the rest is too small for that, it is decided as a whole.
One document of each block is left undecided, the smallest one as a rule. These meet in the next level
of the tree, in pairs of their own probabilities, and so on; the last one of a source is decided alone,
and its size is all that a source's words can miss their target by. A block is small however large a
source is, and the levels grow with its logarithm. All random choices are hashes of the row, the level
and the seed: reruns agree.

Defined cases: a null text has size 0; documents without words take 0 words; null is a source of its
own, the last; rows that agree in id, source and size are told apart by a running number, and the
plain order of these repeats doesn't matter; an empty table or one without words takes nothing; other
input columns are kept by ``mix`` and aren't read by ``decide``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocaris.llm.frames import cut
from vocaris.llm.membership import maybe_in

WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5, 2, 1)
    cap: int = 3
    share: float = 1.0
    block: int = 1024  # documents that are folded in one expression
    most_broadcast: int = 50_000  # sources whose figures are sent to every task; more are joined by salted keys
    salts: int = 64
    seed: int = 17


SETTINGS = Settings()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with pos, 0 for the first by code point, null last: ranks inside range partitions,
    plus how many rows the partitions before have."""
    parts = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()))
    sizes = parts.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    # one row for each partition
    before = sizes.withColumn("before", F.sum("c").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).select("pid", F.coalesce("before", F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("inside", inside).join(before, "pid").withColumn("pos", F.col("before") + F.col("inside") - 1).drop("pid", "inside", "before")


def targets(sources: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """sources (source, source_size) with target and rate."""
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    weighed = cut(ranked(sources).withColumn("w", F.element_at(weights, (F.pmod("pos", F.lit(len(settings.weights))) + 1).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(settings.cap))))
    total = settings.share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while total > 0:
        # sources that a unit weight's share fills stay full, as that share only rises
        above = F.col("most") <= F.col("w") * F.lit(level)
        r = weighed.agg(F.sum(F.when(above, F.col("most"))).alias("filled"), F.sum(F.when(~above, F.col("w"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if r.n == full or not r.open:
            break
        full, level = r.n, (total - (r.filled or 0.0)) / r.open
    target = F.least(F.col("most"), F.col("w") * F.lit(level))
    return weighed.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop("w", "most", "pos")


def _of_source(rows: DataFrame, figures: DataFrame, count: int, settings: Settings) -> DataFrame:
    """rows with the columns of figures, one row a source. Figures of a checked number of sources are
    broadcast; more than that meet their rows under salted keys, so that a hot source has many tasks."""
    named = figures.withColumnRenamed("source", "__s")
    same = F.col("source").eqNullSafe(F.col("__s"))
    if count <= settings.most_broadcast:
        return rows.join(F.broadcast(named), same).drop("__s")
    dealt = rows.withColumn("__n", F.pmod(F.xxhash64("i", "size"), F.lit(settings.salts)).cast("int"))
    copies = named.withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
    return dealt.join(copies, same & (F.col("__n") == F.col("__m"))).drop("__s", "__n", "__m")


_OUT = "array<struct<at:int,x:int,p:double>>"


def _snapped(p: Column) -> Column:
    return F.when(p <= _NEAR, 0.0).when(p >= 1 - _NEAR, 1.0).otherwise(p)


def _entry(at: Column, p: Column) -> Column:
    """Decided where p is 0 or 1."""
    return F.struct(at.alias("at"), F.when((p <= 0) | (p >= 1), p).cast("int").alias("x"), p.alias("p"))


def _fold(items: Column) -> Column:
    """A block of documents of one p, the largest first: each against all that come after it."""

    def step(state: Column, it: Column) -> Column:
        p, s, t = state.p, it.s, state.rest - it.s
        a, b = F.least(s * (1 - p), t * p), F.least(s * p, t * (1 - p))
        moved = F.when((p <= 0) | (p >= 1) | (t < 0.5), 0.0).when(it.u * (a + b) < b, a).otherwise(-b)
        return _let(moved, lambda m: F.struct((state.rest - s).alias("rest"), _snapped(p - F.when(t < 0.5, 0.0).otherwise(m / t)).alias("p"), F.concat(state.out, F.array(_entry(it["at"], _snapped(p + m / s)))).cast(_OUT).alias("out")))

    numbered = F.transform(items, lambda x, k: F.struct(k.cast("int").alias("at"), x["size"].cast("double").alias("s"), x.u.alias("u")))
    total = F.aggregate(items, F.lit(0.0), lambda a, x: a + x["size"])
    start = F.struct(total.alias("rest"), F.element_at(items, 1).p.alias("p"), F.array().cast(_OUT).alias("out"))
    return F.aggregate(numbered, start, step).out


def _fold_pairs(items: Column) -> Column:
    """A block of documents with probabilities of their own: the one that is undecided so far against each."""
    held = "struct<at:int,s:double,p:double>"

    def step(state: Column, it: Column) -> Column:
        c = state.held
        a, b = F.least(c.s * (1 - c.p), it.s * it.p), F.least(c.s * c.p, it.s * (1 - it.p))
        moved = F.when(it.u * (a + b) < b, a).otherwise(-b)

        def after(m: Column) -> Column:
            pair = F.array(F.struct(c["at"].alias("at"), c.s.alias("s"), _snapped(c.p + m / c.s).alias("p")), F.struct(it["at"].alias("at"), it.s.alias("s"), _snapped(it.p - m / it.s).alias("p")))
            open_ = F.filter(pair, lambda x: (x.p > 0) & (x.p < 1))
            done = F.transform(F.filter(pair, lambda x: (x.p <= 0) | (x.p >= 1)), lambda x: _entry(x["at"], x.p))
            return F.struct(F.get(open_, F.lit(0)).cast(held).alias("held"), F.concat(state.out, done).cast(_OUT).alias("out"))

        alone = F.struct(F.struct(it["at"].alias("at"), it.s.alias("s"), it.p.alias("p")).cast(held).alias("held"), state.out.alias("out"))
        return F.when(c.isNull(), alone).otherwise(_let(moved, after))

    numbered = F.transform(items, lambda x, k: F.struct(k.cast("int").alias("at"), x["size"].cast("double").alias("s"), x.p.alias("p"), x.u.alias("u")))
    start = F.struct(F.lit(None).cast(held).alias("held"), F.array().cast(_OUT).alias("out"))
    end = F.aggregate(numbered, start, step)
    return F.when(end.held.isNull(), end.out).otherwise(F.concat(end.out, F.array(_entry(end.held["at"], end.held.p))).cast(_OUT))


_FIGURES = ("source_size", "target", "rows")


def _level(rows: DataFrame, level: int, settings: Settings) -> DataFrame:
    """One level of the tree: every row with x (decided), or with its p then (x null)."""
    salt = F.lit(settings.seed * 1000 + level)
    blocks = F.ceil(F.col("rows") / F.lit(settings.block ** (level + 1))).cast("long")
    block = F.pmod(F.xxhash64("i", "c", "size", salt), blocks)
    placed = rows.withColumn("b", block).withColumn("u", _uniform(F.col("i"), F.col("c"), F.col("size"), salt, F.lit("pair")))
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64("i", "c", "size", salt).alias("h"), "i", "c", "size", "p", "u", "base")
    # the figures are the same in all rows of a source
    groups = placed.groupBy("source", "b").agg(F.sort_array(F.collect_list(item)).alias("items"), *[F.max(c).alias(c) for c in _FIGURES])
    each = groups.select("source", "items", *_FIGURES, F.explode((_fold if level == 0 else _fold_pairs)(F.col("items"))).alias("o"))
    at = F.element_at("items", F.col("o.at") + 1)
    return each.select("source", *[at[c].alias(c) for c in ("i", "c", "size", "base")], *_FIGURES, "o.p", "o.x")


def decide(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", settings: Settings = SETTINGS) -> DataFrame:
    """id, source, size, source_size, target, copies and taken of every row. Each text is read once,
    for its size."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(df.select(F.col(id_col).alias("i"), F.col(source_col).alias("source"), size.alias("size")).groupBy("i", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    words, rows_ = F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("m")).otherwise(0)).alias("rows")
    totals = cut(sized.groupBy("source").agg(words, rows_))
    sources = cut(targets(totals, settings))
    most = sources.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).first()

    r = F.col("rate")
    rate = F.when(F.abs(r - F.round(r)) < _NEAR, F.round(r)).otherwise(r)
    items = (
        _of_source(sized, sources.select("source", "rate", *_FIGURES), most.n, settings)
        .select("i", "source", "size", *_FIGURES, F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("c"), F.floor(rate).cast("int").alias("base"), (rate - F.floor(rate)).alias("p"))
    )
    sure = (F.col("size") == 0) | (F.col("p") <= 0)
    out = ["i", "source", "size", "source_size", "target", "base", "x"]
    done = [items.where(sure).withColumn("x", F.lit(0)).select(out)]
    rows, level = items.where(~sure), 0
    while True:
        rows = cut(_level(rows, level, settings))
        done.append(rows.where("x is not null").select(out))
        rows, level = rows.where("x is null").drop("x"), level + 1
        if (most.rows or 0) <= settings.block**level:
            break
    # at most one document of each source is left, which its probability decides alone
    last = F.when(_uniform(F.col("i"), F.col("c"), F.col("size"), F.lit(settings.seed), F.lit("last")) < F.col("p"), 1).otherwise(0)
    done.append(rows.withColumn("x", last).select(out))
    copies = (F.col("base") + F.col("x")).cast("int")
    return reduce(DataFrame.unionByName, done).select(F.col("i").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", settings: Settings = SETTINGS) -> DataFrame:
    """The mix itself: df's rows with df's columns, each as often as it is taken. A document without
    words is not in it.

    Two filters keep most texts where they are: one of the keys (id, source, size) that aren't taken as
    one row once, and one of the keys that are taken at all. A row surely outside the first is taken
    once, another one surely outside the second is dropped; only the rest move, in one exchange."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")

    def key(n: Column) -> Column:
        return F.to_json(F.struct(F.col(id_col).alias("i"), F.col(source_col).alias("s"), n.alias("n")), {"ignoreNullFields": "false"})

    # rows that agree in id, source and size: how many there are, and how many are taken at least k times
    times = [F.count(F.when(F.col("copies") >= k, 1)).alias(f"__c{k}") for k in range(1, settings.cap + 1)]
    counts = decide(df, id_col, source_col, text_col, settings).where("size > 0").groupBy(key(F.col("size")).alias("__k")).agg(F.count(F.lit(1)).alias("__m"), F.sum("copies").alias("__t"), *times)
    counts = cut(counts)
    taken, plain = counts.where("__t > 0"), (F.col("__m") == 1) & (F.col("__t") == 1)
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), key(size).alias("__key"), (size > 0).alias("__words")).where("__words").drop("__words")
    split = maybe_in(packed, "__key", counts.where(~plain).select("__k"), "__k")
    once = split.where("not __maybe").select("__row")
    likely = maybe_in(split.where("__maybe").select("__row", "__key"), "__key", taken.select("__k"), "__k").where("__maybe")
    moved = likely.select("__row", "__key").join(taken, F.col("__key") == F.col("__k"))
    number = F.row_number().over(Window.partitionBy("__k").orderBy(F.when(F.col("__m") > 1, F.md5(F.to_json("__row")))))
    several = reduce(lambda a, b: a + b, [F.when(F.col("__n") <= F.col(f"__c{k}"), 1).otherwise(0) for k in range(1, settings.cap + 1)])
    copies = moved.withColumn("__n", number).withColumn("__times", several).where("__times > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return once.select("__row.*").unionByName(copies.select("__row.*"))
