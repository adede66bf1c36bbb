"""Connected components and bucket-wise linking as DataFrame operations alone.

Groups of thousands of similar rows never become all their pairs: a bucket's members are compared with
one hub first, and members that this leaves in different components only with those that share a rare token
of theirs (a prefix filter, which misses no linked pair).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import Staged, scratch, stage

MAX_ROUNDS = 60
#: In buckets of up to so many members nothing is gained by comparing neighbours before all.
CROWD = 8


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, form stars: every u has one v, and no v is a u."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.isEmpty() and edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi").isEmpty()


def _star(directed: DataFrame, keep) -> DataFrame:
    """Connect the neighbours v of each u (with u itself) to the least of them."""
    least = directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return directed.join(least, "u").select(*keep).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, label): the least node of each component, for all nodes that have an edge.

    Alternates large-star and small-star steps; every round is a written table, so lineage stays short.
    """
    held = Staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(held.df):
            break
        e = held.df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, (F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")))
        small = _star(large, (F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")))
        new = Staged(small)
        held.drop()
        held = new
    else:
        raise RuntimeError("components did not settle")
    stars = held.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class Kind(Protocol):
    """What link_buckets has to know of the things it links."""

    #: How often buckets of several components get another hub before their members are compared by tokens.
    rounds: int

    #: With how many of a bucket's other members each is compared after that, if their sketches are near.
    neighbours: int

    #: (id, sketch) of all ids that prepare() was called with.
    sketches: DataFrame

    def near(self, a: str, b: str) -> Column:
        """Whether two sketches make it likely that their owners are linked: these are compared first."""

    def open(self, a: str, b: str) -> Column:
        """Whether two sketches leave it open that their owners are linked."""

    def prepare(self, ids: DataFrame) -> None:
        """ids (id): called once, before all else, with all ids that can be asked for."""

    def verify(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) -> those that are linked."""

    def tokens(self, ids: DataFrame) -> DataFrame:
        """ids (id) -> (id, n, size, token): the distinct tokens of each, and how many they are."""

    def prefix(self, n: Column, known: Column, size: Column) -> Column:
        """Of n tokens, `known` of them in others too: so many of the rarest of these a linked pair meets in."""

    def shared(self, n: tuple[Column, Column], size: tuple[Column, Column]) -> Column:
        """How many tokens a linked pair shares at the least."""


@dataclass
class Links:
    """node, label of all ids that are linked with others, and how many pairs were compared on the way."""

    labels: DataFrame
    compared: int


def link_buckets(members: DataFrame, kind: Kind) -> Links:
    """members (bucket, id), each once. Two ids end in one component exactly if a chain
    of linked pairs, each sharing a bucket, joins them.

    First every member is compared with its bucket's hub, the id that meets most others over all its buckets
    (of a family of near copies that is the original, which they resemble more than each other), and in further
    rounds, if its kind asks for them, with other hubs and with some of the others. Where other
    members of a bucket are still in different components, these are compared through their rarest tokens:
    a linked pair has so many tokens in common that it shares one among the first few of both in one order
    from rare to frequent. A copy that is too far from all others has too many tokens of its own to meet them
    there, so candidates follow the links and not the square of a group.
    """
    with scratch():
        by = Window.partitionBy("bucket").orderBy("id")
        around = members.select("bucket", "id", F.lag("id").over(by).alias("before"), F.lead("id").over(by).alias("after"))
        held = stage(around.where("before is not null or after is not null").select("bucket", "id"))
        often = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        central = held.join(often, "bucket").groupBy("id").agg(F.sum("n").alias("weight"))
        hubs = held.join(central, "id").groupBy("bucket").agg(F.max_by("id", "weight").alias("hub"))
        multi = stage(held.join(hubs, "bucket").where("id <> hub").select("bucket", "id", "hub"))
        kind.prepare(held.select("id").distinct())
        sketches = kind.sketches
        of_hub = sketches.select(F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch"))
        star = multi.select("id", "hub").distinct().join(sketches, "id").join(of_hub, "hub").where(kind.open("sketch", "hub_sketch"))
        star = stage(star.select(F.col("hub").alias("a"), F.col("id").alias("b"), kind.near("sketch", "hub_sketch").alias("near")))
        pairs = star.where("near").select("a", "b")
        compared = pairs.count()
        first = stage(kind.verify(pairs).select("a", "b"))
        labels = stage(components(first), keep=True)
        for k in range(kind.rounds):
            pairs = stage(_with_new_hubs(multi, labels, sketches, kind, k))
            compared += pairs.count()
            more = stage(kind.verify(pairs).select("a", "b"))
            if more.isEmpty():
                break
            labels = stage(components(_stars(labels).union(more)), keep=True)
        if kind.neighbours:
            pairs = stage(_with_neighbours(multi, labels, sketches, kind))
            compared += pairs.count()
            more = stage(kind.verify(pairs).select("a", "b"))
            if not more.isEmpty():
                labels = stage(components(_stars(labels).union(more)), keep=True)
        rest = stage(_unresolved(multi, labels))
        late = stage(_apart(star.where("not near").select("a", "b"), labels))
        if rest.isEmpty() and late.isEmpty():
            return Links(labels, compared)
        pairs = stage(_by_rare_tokens(rest, kind).union(late).distinct())
        compared += pairs.count()
        second = stage(kind.verify(pairs).select("a", "b"))
        if second.isEmpty():
            return Links(labels, compared)
        return Links(stage(components(_stars(labels).union(second)), keep=True), compared)


def _stars(labels: DataFrame) -> DataFrame:
    """Edges that give these labels."""
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")


def _with_new_hubs(multi: DataFrame, labels: DataFrame, sketches: DataFrame, kind: Kind, k: int) -> DataFrame:
    """Pairs (a, b) of other components: members of buckets that hold several, each with one that all buckets choose
    alike, by a hash, from those outside their largest component."""
    known = labels.select(F.col("node").alias("id"), "label")
    placed = stage(multi.select("bucket", "id").join(known, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("comp")))
    sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "comp")).alias("some"))
    large = Window.partitionBy("bucket").orderBy(F.desc("n"), "comp")
    outer = sizes.withColumn("place", F.row_number().over(large)).where("place > 1").groupBy("bucket").agg(F.min("some").alias("some"))
    hubs = outer.select("bucket", F.col("some.id").alias("hub"), F.col("some.comp").alias("hub_comp"))
    met = placed.join(hubs, "bucket").where("comp <> hub_comp").select("id", "hub").distinct()
    of_hub = sketches.select(F.col("id").alias("hub"), F.col("sketch").alias("hub_sketch"))
    star = met.join(sketches, "id").join(of_hub, "hub").where(kind.near("sketch", "hub_sketch"))
    return star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _with_neighbours(multi: DataFrame, labels: DataFrame, sketches: DataFrame, kind: Kind) -> DataFrame:
    """Pairs (a, b) of other components: members of buckets of more than CROWD, each with some that follow it in
    an order that differs from bucket to bucket. In a family whose members are linked to some others, but not to its hubs, few of all pairs are enough to join them."""
    known = labels.select(F.col("node").alias("id"), "label")
    crowded = multi.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("bucket")
    placed = multi.select("bucket", "id").join(crowded, "bucket").join(known, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("comp")).join(sketches, "id")
    by = Window.partitionBy("bucket").orderBy(F.xxhash64("id", "bucket"), "id")
    after = [F.lead(F.struct("id", "comp", "sketch"), i).over(by) for i in range(1, kind.neighbours + 1)]
    followed = placed.select("id", "comp", "sketch", F.array(*after).alias("after"))
    each = followed.select("id", "comp", "sketch", F.explode("after").alias("next")).where("next.comp <> comp")
    met = each.select("id", "sketch", F.col("next.id").alias("other"), F.col("next.sketch").alias("other_sketch")).where(kind.near("sketch", "other_sketch"))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _unresolved(multi: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comp, outer): members of buckets that hold, besides their hub, several components; outer: not in
    the largest component of one of these buckets."""
    known = labels.select(F.col("node").alias("id"), "label")
    placed = multi.select("bucket", "id").join(known, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("comp"))
    ends = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.max_by("comp", "n").alias("major")).where("kinds > 1")
    return placed.join(ends.select("bucket", "major"), "bucket").groupBy("id").agg(F.min("comp").alias("comp"), F.max(F.col("comp") != F.col("major")).alias("outer"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are not in one component."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}")), end, "left")
    return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _by_rare_tokens(rest: DataFrame, kind: Kind) -> DataFrame:
    """rest (id, comp, outer) -> pairs (a, b) of different components, one of them outer, that may be linked."""
    tokens = stage(kind.tokens(rest.select("id")))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(often, "token").join(rest, "id")
    order = Window.partitionBy("id").orderBy("df", "token")
    n, size = F.col("n"), F.col("size")
    # tokens that nothing else has come first in the order, and join with nothing
    ranked = known.withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("id"))).withColumn("rank", F.row_number().over(order))
    placed = ranked.withColumn("place", n - F.col("known") + F.col("rank"))
    prefix = stage(placed.where(F.col("rank") <= kind.prefix(n, F.col("known"), size)).join(kind.sketches, "id").select("token", "id", "comp", "outer", "n", "size", "place", "sketch"))
    x = prefix.where("outer").select("token", *[F.col(c).alias(f"x_{c}") for c in ("id", "comp", "n", "size", "place", "sketch")])
    y = prefix.select("token", *[F.col(c).alias(f"y_{c}") for c in ("id", "comp", "outer", "n", "size", "place", "sketch")])
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place")) + 1  # tokens from this one on
    able = left >= kind.shared((F.col("x_n"), F.col("y_n")), (F.col("x_size"), F.col("y_size")))
    once = ~F.col("y_outer") | (F.col("x_id") < F.col("y_id"))
    met = x.join(y, (x["token"] == y["token"]) & (F.col("x_comp") != F.col("y_comp")) & once & able & kind.open("x_sketch", "y_sketch"))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))
