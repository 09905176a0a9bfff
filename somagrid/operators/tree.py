"""Region tree: closure, subtree joins, exclusions, roll-up."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, functions as F

from somagrid.session import TASK_ROWS, cut, shared_out, spread


def with_children(onto: DataFrame) -> DataFrame:
    """Add the child-id array to an (ids, .., parent, ..) table."""
    kids = onto.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(F.sort_array(F.collect_list("ids")).alias("children"))
    return onto.join(kids, F.col("ids") == F.col("_p"), "left").drop("_p").withColumn(
        "children", F.coalesce("children", F.array().cast("array<bigint>"))
    )


def chains(up: DataFrame, keys: list[str], node: str, ancestor: str, step: str = "step") -> DataFrame:
    """Every node with all of its ancestors and their distance, from (node, next ancestor) rows that hold no circle.

    Known chains double in length each round, so rounds grow with the log of the depth; each writes the rows it adds, once.
    Chains are many small numbers, which Spark's choice of join and tasks by compressed size does not see: many are dealt by rows."""
    parts, n = [cut(up.select(*keys, node, ancestor).withColumn(step, F.lit(1)))], 1
    while True:
        known = functools.reduce(DataFrame.unionByName, parts)
        far = known.filter(F.col(step) == n)
        if far.isEmpty():
            return known
        rows = known.count()
        far, known = shared_out(far, rows, *keys, ancestor), shared_out(known, rows, *keys, node)
        if rows > TASK_ROWS:
            far, known = spread(far), spread(known)
        on = functools.reduce(operator.and_, [F.col(f"f.{k}") == F.col(f"k.{k}") for k in keys] + [F.col(f"f.{ancestor}") == F.col(f"k.{node}")])
        more = far.alias("f").join(known.alias("k"), on)
        parts.append(cut(more.select(*[f"f.{k}" for k in keys], f"f.{node}", f"k.{ancestor}", (F.col(f"k.{step}") + n).alias(step))))
        n *= 2


def closure(onto: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth), each region being its own ancestor.

    The tree may be of any depth; a parent that is no region of its own ends the way up."""
    own = onto.select("ids", "parent")
    up = own.join(own.select(F.col("ids").alias("parent")).distinct(), "parent", "left_semi").select(F.col("ids").alias("descendant"), F.col("parent").alias("ancestor"))
    far = chains(up, [], "descendant", "ancestor", "depth").select("ancestor", "descendant", "depth")
    return own.select(F.col("ids").alias("ancestor"), F.col("ids").alias("descendant"), F.lit(0).alias("depth")).unionByName(far)


def subtree_ids(onto: DataFrame, names: list[str], by: str = "names") -> DataFrame:
    """Ids of the named regions and everything below them."""
    roots = onto.filter(F.col(by).isin(*names)).select(F.col("ids").alias("ancestor"))
    return closure(onto).join(roots, "ancestor").select(F.col("descendant").alias("ids")).distinct()


def in_subtree(df: DataFrame, onto: DataFrame, names: list[str], how: str = "keep", by: str = "names", on: str = "ids") -> DataFrame:
    """Keep or drop the rows whose region lies in a subtree."""
    ids = subtree_ids(onto, names, by).withColumnRenamed("ids", "_id")
    return df.join(ids, F.col(on) == F.col("_id"), "left_semi" if how == "keep" else "left_anti")


def tag_groups(df: DataFrame, onto: DataFrame, groups: dict[str, list[str]], on: str = "ids", by: str = "names") -> DataFrame:
    """Region group by subtree membership; the first listed group wins, else NULL."""
    parts = [subtree_ids(onto, names, by).select(F.col("ids").alias("_id"), F.lit(i).alias("_g")) for i, names in enumerate(groups.values())]
    tags = functools.reduce(DataFrame.unionByName, parts).groupBy("_id").agg(F.min("_g").alias("_g"))
    label = functools.reduce(lambda w, g: w.when(F.col("_g") == g[0], g[1]), enumerate(groups), F)
    return df.join(tags, F.col(on) == F.col("_id"), "left").withColumn("region_group", label).drop("_id", "_g")


def apply_exclusions(regions: DataFrame, onto: DataFrame, brains: DataFrame, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Torn-region rules of each brain.

    A side L or R copies that side's count over both and doubles the whole;
    B (or an empty side) drops the subtree.  Entries apply in list order, and
    once both sides are equal a later side changes nothing, so the first side
    wins.  If the first entry names "all", it alone applies to every region.
    """
    fixed = F.array(*[F.struct(F.lit(a).alias("acronym"), F.lit(s).alias("side")) for a, s in extra])
    lists = brains.select("dataset", F.concat("exclude", fixed).alias("e") if extra else F.col("exclude").alias("e"))
    whole = F.try_element_at("e", F.lit(1))["acronym"] == "all"
    all_side = lists.filter(whole).select("dataset", F.col("e")[0]["side"].alias("_all"))
    entries = lists.filter(~F.coalesce(whole, F.lit(False))).select("dataset", F.posexplode("e").alias("pos", "x"))
    tree = closure(onto).join(onto.select(F.col("ids").alias("ancestor"), "acronym"), "ancestor")
    hit = entries.join(tree, F.col("x.acronym") == F.col("acronym")).select(
        "dataset", F.col("descendant").alias("ids"), F.col("x.side").alias("side"), "pos"
    )
    both = F.col("side").isin("B", "")
    rule = hit.groupBy("dataset", "ids").agg(
        F.bool_or(both).alias("_drop"), F.min_by(F.when(~both, F.col("side")), F.when(~both, F.col("pos"))).alias("_side")
    )
    j = regions.join(rule, ["dataset", "ids"], "left").join(all_side, "dataset", "left")
    side = F.coalesce("_all", "_side")
    one = F.when(side == "L", F.col("num_l")).when(side == "R", F.col("num_r"))
    return (
        j.filter(~F.coalesce("_drop", F.lit(False))).withColumn("_one", one)
        .withColumn("num_l", F.coalesce("_one", "num_l")).withColumn("num_r", F.coalesce("_one", "num_r"))
        .withColumn("num_w", F.coalesce(F.col("_one") * 2, F.col("num_w"))).drop("_one", "_drop", "_side", "_all")
    )


def prune_children(onto: DataFrame, erased: DataFrame) -> DataFrame:
    """Rows that stay, with the erased ids taken out of their child lists.

    Lists shorten through a join on (parent, erased child), so the erased ids are never gathered."""
    gone = erased.select(F.col("ids").alias("_id")).distinct()
    left = onto.join(gone, F.col("ids") == F.col("_id"), "left_anti")
    kids = left.select("ids", F.posexplode("children").alias("_pos", "_id"))
    hit = kids.join(gone, "_id").groupBy("ids").agg(F.collect_set("_id").alias("_out"))
    return left.join(hit, "ids", "left").withColumn("children", F.when(F.col("_out").isNotNull(), F.array_except("children", "_out")).otherwise(F.col("children"))).drop("_out").select(*onto.columns)


def rollup_tree(regions: DataFrame, sums: list[str], keys=("dataset",), volume: str = "vol_w", levels: list[int] | None = None) -> DataFrame:
    """Deepest level first, a parent without a volume of its own takes the sum of
    its direct children (missing values count as 0); others keep their values.

    One shuffle per level over the region table (brains x regions, not cells):
    each row is sent to its own id and, as a share, to its parent's id, so the
    table is never joined with itself.  Only numbers go through the levels (hash
    aggregates); the other columns come back in one join at the end.
    """
    regions = cut(regions)
    if levels is None:
        levels = sorted((r[0] for r in regions.select("st_level").distinct().collect()), reverse=True)
    fixed = ["parent", "st_level"]
    done = regions.select(*keys, "ids", *fixed, *sums)
    for level in levels[1:]:
        sent = done.withColumn("_to", F.explode(F.array(F.struct(F.col("ids").alias("id"), F.lit(True).alias("own")),
                                                        F.struct(F.col("parent").alias("id"), F.lit(False).alias("own")))))
        own = F.col("_to.own")
        g = sent.filter(F.col("_to.id").isNotNull()).groupBy(*keys, F.col("_to.id").alias("ids")).agg(
            F.bool_or(own).alias("_own"), F.bool_or(~own).alias("_kids"),
            *[F.max(F.when(own, F.col(c))).alias(c) for c in (*fixed, *sums)],
            *[F.coalesce(F.sum(F.when(~own, F.col(c))), F.lit(0)).alias(f"_{c}") for c in sums],
        ).filter("_own")
        take = (F.col("st_level") == level) & F.col(volume).isNull() & F.col("_kids")
        g = g.withColumn("_take", take)
        done = g.select(*keys, "ids", *fixed, *[F.when(F.col("_take"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in sums])
    rest = [c for c in regions.columns if c not in (*keys, "ids", *fixed, *sums)]
    if rest:
        done = done.join(regions.select(*keys, "ids", *rest), [*keys, "ids"])
    return done.select(*regions.columns)


def weighted_mean_tree(df: DataFrame, onto: DataFrame, value: str, weight: str, keys=("dataset",)) -> DataFrame:
    """Weighted mean over all descendants of each region."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return (
        df.filter(both).join(closure(onto), F.col("ids") == F.col("descendant"))
        .groupBy(*keys, F.col("ancestor").alias("ids"))
        .agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("weighted_mean"))
    )


def subtree_stats(objs: DataFrame, onto: DataFrame, values: list[str], brain: str = "dataset", on: str = "ids") -> DataFrame:
    """Per region over all descendants: mean per brain, then mean and SEM over
    brains, and the mean number of objects.

    Objects are first reduced per (region, brain), so the closure join meets
    the small table.
    """
    part = objs.groupBy(F.col(on).alias("descendant"), brain).agg(
        F.count(F.lit(1)).alias("_n"),
        *[e for v in values for e in (F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_c_{v}"))],
    )
    per = part.join(closure(onto), "descendant").groupBy("ancestor", brain).agg(
        F.sum("_n").alias("_n"), *[F.try_divide(F.sum(f"_s_{v}").cast("double"), F.sum(f"_c_{v}")).alias(v) for v in values]
    )
    return per.groupBy(F.col("ancestor").alias("ids")).agg(
        F.avg("_n").alias("n_objects"),
        *[e for v in values for e in (
            F.avg(v).alias(f"mean_{v}"), F.try_divide(F.stddev_samp(v), F.sqrt(F.count(v))).alias(f"sem_{v}"))],
    )


def find_regions(onto: DataFrame, words: list[str]) -> DataFrame:
    """Regions whose folded name holds any of the words."""
    return onto.filter(functools.reduce(operator.or_, [F.lower("names").contains(w) for w in words]))


def by_depth(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("st_level"), "ids")


def regions_to_show(
    means: DataFrame, onto: DataFrame, name: str, value: str = "density_w", remove: str = "", low: int = 5, high: int = 9
) -> DataFrame:
    """Regions of a subtree between two levels (exclusive) with a value, largest first."""
    sub = in_subtree(onto.select("ids", "names", "acronym"), onto, [name]).filter(~F.col("acronym").rlike(f"^(?:{remove})$"))
    d = means.join(sub.select("acronym"), "acronym", "left_semi").filter(F.col("density_w").isNotNull())
    return d.filter((F.col("st_level") < high) & (F.col("st_level") > low)).orderBy(F.desc(value), "acronym")
