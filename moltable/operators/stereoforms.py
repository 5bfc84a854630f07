"""Stereogenic loci, stereo forms and stereoisomers over declared configurations.

Declared configurations are rows (mol_id, locus_kind, locus_id, kind, neighbors), with a tag where a molecule
has several assignments.  Each is read as a descriptor by the classes of its neighbours; descriptors colour the
sites of their locus, and colouring and descriptors are repeated for every molecule until no more classes arise.
Molecules of ordinary size go through all of this as rows of arrays (`smallstereo`), larger ones by joins, with the
same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import rotations, smallgraphs, smallstereo
from .frames import BOND_LOCUS, frames, kinds_of
from .symmetry import KEY, PACKED, Ties, _sums, certificate, certificates, classes, colours, parts, stable, ties

LOCUS = ["locus_kind", "locus_id"]
DECLARED = "mol_id long, tag long, locus_kind int, locus_id long, kind int, neighbors array<long>"


def tagged(declared: DataFrame) -> DataFrame:
    """Declared configurations in their least order, of tag 0 unless they have one."""
    tag = F.col("tag") if "tag" in declared.columns else F.lit(0)
    return rotations.configurations(declared.select("mol_id", tag.cast("long").alias("tag"), F.col("locus_kind").cast("int").alias("locus_kind"), "locus_id", F.col("kind").cast("int").alias("kind"), "neighbors"))


def signals(declared: DataFrame, bonds: DataFrame, colour: DataFrame, mirrored: DataFrame | None = None) -> DataFrame:
    """(mol_id, tag, site_id, lo, hi): what the configurations say at each site that anchors some, by the ranks of `colour`.

    A bond speaks at both its ends.  mirrored holds the (mol_id, tag) that take mirror images.
    """
    slots = declared.select(*KEY, *LOCUS, "kind", F.size("neighbors").alias("n"), F.posexplode("neighbors").alias("slot", "site_id")).join(colour, [*KEY, "site_id"])
    ranks = slots.groupBy(*KEY, *LOCUS, "kind", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "rank"))), lambda e: e["rank"]).alias("ranks"))
    got = rotations.descriptors(ranks.where(F.size("ranks") == F.col("n")).drop("n"))
    if mirrored is None:
        said = got.withColumn("said", F.xxhash64("kind", "descriptor"))
    else:
        said = got.join(mirrored.select(*KEY, F.lit(True).alias("flip")), KEY, "left").withColumn("said", F.when(F.col("flip"), F.xxhash64("kind", "mirror")).otherwise(F.xxhash64("kind", "descriptor")))
    at = said.where(F.col("locus_kind") != BOND_LOCUS).select(*KEY, F.col("locus_id").alias("site_id"), "said")
    ends = bonds.select("mol_id", F.col("bond_id").alias("locus_id"), F.explode(F.array("a", "b")).alias("site_id"))
    both = said.where(F.col("locus_kind") == BOND_LOCUS).join(ends, ["mol_id", "locus_id"]).select(*KEY, "site_id", "said")
    return at.unionByName(both).groupBy(*KEY, "site_id").agg(*_sums(F.col("said")))


def _with(key: DataFrame, signal: DataFrame) -> DataFrame:
    """Colours with signals folded in; a site without one keeps its colour."""
    return key.join(signal, [*KEY, "site_id"], "left").select(*KEY, "site_id", F.when(F.col("lo").isNull(), F.col("colour")).otherwise(F.xxhash64("colour", "lo", "hi")).alias("colour"))


def refined(key: DataFrame, bonds: DataFrame, tie: Ties, declared: DataFrame, mirrored: DataFrame | None = None) -> DataFrame:
    """(mol_id, tag, site_id, colour, rank) of every colouring when stereochemistry adds no more classes.

    A rank is the list of a site's colours round by round: ranks order first by what earlier rounds told apart, so that
    descriptors of sites that were unlike once stay unlike.
    """
    live = stored(classes(key, tie), "classes").withColumn("rank", F.array("colour"))
    said = stored(declared.select(*KEY).distinct(), "said")
    done = [live.join(said, KEY, "left_anti")]
    live = stored(live.join(said, KEY, "left_semi"), "live")
    while not live.isEmpty():
        began = stored(_with(live, signals(declared, bonds, live, mirrored)), "began")
        new = stored(classes(began, tie), "classes")
        both = live.join(new.withColumnRenamed("colour", "next"), [*KEY, "site_id"])
        grown = both.groupBy(*KEY).agg((F.count_distinct("next") > F.count_distinct("colour")).alias("grown"))
        step = stored(both.join(grown, KEY).select(*KEY, "site_id", F.when(F.col("grown"), F.col("next")).otherwise(F.col("colour")).alias("colour"), F.when(F.col("grown"), F.concat("rank", F.array("next"))).otherwise(F.col("rank")).alias("rank"), "grown"), "round")
        done.append(step.where("not grown").drop("grown"))
        live = step.where("grown").drop("grown")
    return stored(_union(done), "refined")


def settle(key: DataFrame, bonds: DataFrame, tie: Ties, declared: DataFrame) -> DataFrame:
    """The caller's colours with what the configurations say by the refined classes."""
    got = refined(key, bonds, tie, declared)
    return stored(_with(key, signals(declared, bonds, got)), "settled")


def _ordered(own: DataFrame, colour: DataFrame, degree: DataFrame) -> DataFrame:
    """own (mol_id, tag, locus, kind, neighbors) with neighbours in order of class within each end, the pattern of their
    classes, and whether a tie of neighbours with bonds of their own is left."""
    rigid = F.col("kind") >= rotations.BOND
    slot = own.select(*KEY, *LOCUS, "kind", F.posexplode("neighbors").alias("slot", "site_id"))
    slot = slot.join(colour, [*KEY, "site_id"]).join(degree, ["mol_id", "site_id"]).withColumn("end", F.when(rigid, F.floor(F.col("slot") / 2)).otherwise(0).cast("int"))
    got = slot.groupBy(*KEY, *LOCUS, "kind").agg(F.array_sort(F.collect_list(F.struct("end", "colour", "site_id", "d"))).alias("v"))
    below = F.transform("v", lambda e: F.size(F.filter("v", lambda f: (f["end"] == e["end"]) & (f["colour"] < e["colour"]))))
    tied = F.exists("v", lambda e: (e["d"] > 1) & (F.size(F.filter("v", lambda f: (f["end"] == e["end"]) & (f["colour"] == e["colour"]))) > 1))
    return got.select(*KEY, *LOCUS, "kind", F.transform("v", lambda e: e["site_id"]).alias("neighbors"), F.array_join(F.transform(below, lambda i: i.cast("string")), ",").alias("pattern"), tied.alias("tied"))


def realizable(own: DataFrame, colour: DataFrame, tie: Ties) -> DataFrame:
    """(mol_id, tag, locus_kind, locus_id, kind, neighbors, admitted) of the loci that have more than one configuration.

    own are frames with kinds under every tag, colour a settled colouring.  Classes hold with the frame's anchors made
    individual: only loci whose plain classes tie neighbours with bonds of their own need that, each as a
    colouring of its own.  neighbors are in order of class, admitted are the orders of them.
    """
    many = F.broadcast(rotations.admits(own.sparkSession))
    degree = stored(tie.rows.groupBy("mol_id", "site_id").agg(F.count("*").alias("d")), "degrees")
    flat = stable(colour, tie)
    first = stored(_ordered(own, flat, degree).join(many, ["kind", "pattern"]), "patterns")
    open_ = first.where("size(admitted) = 1 and tied").select(*KEY, *LOCUS).join(own, [*KEY, *LOCUS]).withColumn("to", F.xxhash64("tag", *LOCUS))
    open_ = stored(open_, "individual")
    parts = [first.where("size(admitted) > 1")]
    if not open_.isEmpty():
        mark = F.coalesce(F.array_position("anchors", F.col("site_id")), F.lit(0).cast("long"))
        each = flat.join(open_.select(*KEY, "anchors", "to"), KEY).select("mol_id", F.col("to").alias("tag"), "site_id", F.xxhash64("colour", mark).alias("colour"))
        again = _ordered(open_.withColumn("old", F.col("tag")).withColumn("tag", F.col("to")).select(*KEY, *LOCUS, "kind", "neighbors"), stable(each, tie), degree).join(many, ["kind", "pattern"])
        back = open_.select("mol_id", F.col("tag").alias("old"), F.col("to").alias("tag"), *LOCUS)
        parts.append(again.join(back, [*KEY, *LOCUS]).withColumn("tag", F.col("old")).select(*first.columns).where("size(admitted) > 1"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.select(*KEY, *LOCUS, "kind", "neighbors", "admitted")


def _bearing(loci: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of molecules that have loci; no colour of another molecule says anything about these."""
    own = stored(loci.select("mol_id").distinct(), "bearing")
    return [stored(df.join(own, "mol_id", "left_semi"), "bearing-rows") for df in tables]


def _said(rows: DataFrame) -> DataFrame:
    """Configurations of each colouring as an array, as `smallstereo` reads them."""
    e = F.struct(*(F.col(c).cast(k).alias(c) for c, k in (("locus_kind", "int"), ("locus_id", "long"), ("kind", "int"), ("neighbors", "array<long>"))))
    return rows.groupBy(*KEY).agg(F.collect_list(e).cast(smallstereo.SAID).alias("said"))


def _framed(row: DataFrame, own: DataFrame) -> DataFrame:
    """The rows that have loci, with these."""
    e = F.struct(*(F.col(c).cast(k).alias(c) for c, k in (("locus_kind", "int"), ("locus_id", "long"), ("kind", "int"), ("anchors", "array<long>"), ("neighbors", "array<long>"))))
    return row.join(own.groupBy("mol_id").agg(F.collect_list(e).cast(smallstereo.LOCI).alias("loci")), "mol_id")


def _unsaid(row: DataFrame) -> DataFrame:
    return row.withColumn("said", F.lit(None).cast(smallstereo.SAID))


def stereocenters(
    sites: DataFrame, bonds: DataFrame, geometry: DataFrame, declared: DataFrame | None = None, site_key: str = "element", bond_key: str = "bond_order", frame: DataFrame | None = None, packed: int = PACKED
) -> DataFrame:
    """(mol_id, locus_kind, locus_id, kind) of the loci that are stereogenic in the molecules as declared.

    geometry (mol_id, site_id, geometry) gives sites their kind; without declared configurations the constitution alone decides.
    """
    own = kinds_of(frames(sites, bonds) if frame is None else frame, geometry)
    tie = ties(sites, bonds, bond_key, packed)
    row, _ = parts(colours(sites, site_key), tie)
    if row is None:
        return _joined_stereocenters(sites, bonds, own, declared, site_key, bond_key, tie)
    if tie.large is not None:
        own = stored(own, "loci")
    row = _framed(row, own)
    row = _unsaid(row) if declared is None else row.join(_said(tagged(declared)), KEY, "left")
    small = smallstereo.stereocenters(row).select("mol_id", "locus_kind", F.col("locus_id").cast(own.schema["locus_id"].dataType).alias("locus_id"), "kind")
    if tie.large is None:
        return small
    far = (None if df is None else smallgraphs.within(df, tie.large) for df in (sites, bonds, own, declared))
    return small.unionByName(_joined_stereocenters(*far, site_key, bond_key, Ties(tie.rows, None, None)))


def _joined_stereocenters(sites: DataFrame, bonds: DataFrame, own: DataFrame, declared: DataFrame | None, site_key: str, bond_key: str, tie: Ties) -> DataFrame:
    """The loci of stereocenters() by joins, for molecules of any size."""
    own = stored(own.withColumn("tag", F.lit(0).cast("long")), "loci")
    sites, bonds = _bearing(own, sites, bonds)
    if declared is not None:
        (declared,) = _bearing(own, declared)
    tie, key = Ties(tie.rows, None, None), stored(colours(sites, site_key), "keys")
    colour = key if declared is None else settle(key, bonds, tie, stored(tagged(declared), "declared"))
    return realizable(own, colour, tie).select("mol_id", *LOCUS, "kind")


def consistency(sites: DataFrame, bonds: DataFrame, geometry: DataFrame, declared: DataFrame, site_key: str = "element", bond_key: str = "bond_order", frame: DataFrame | None = None) -> DataFrame:
    """(mol_id, locus_kind, locus_id, finding) of declared configurations against the stereogenic loci."""
    from .stereo import consistency as compared

    return compared(declared.select("mol_id", *LOCUS), stereocenters(sites, bonds, geometry, declared, site_key, bond_key, frame))


def forms(sites: DataFrame, bonds: DataFrame, declared: DataFrame, site_key: str = "element", bond_key: str = "bond_order", packed: int = PACKED) -> DataFrame:
    """(mol_id, tag, constitution, configured, mirror): identity without stereochemistry, with it, and of the mirror image.

    sites may have a tag, one for each assignment of a molecule.  stereo.relate and stereo.is_chiral read these rows.
    """
    tie, key = ties(sites, bonds, bond_key, packed), colours(sites, site_key)
    row, more = parts(key, tie)
    if row is None:
        return _joined_forms(key, bonds, declared, tie)
    small = _forms(row.join(_said(tagged(declared)), KEY, "left"))
    if tie.large is None:
        return small
    far = _joined_forms(more, smallgraphs.within(bonds, tie.large), smallgraphs.within(declared, tie.large), Ties(tie.rows, None, None))
    return small.unionByName(far)


def _forms(row: DataFrame) -> DataFrame:
    got = smallstereo.forms(row)
    return got.select(*KEY, *(certificate(f"lo{i}", f"hi{i}", f"k{i}").alias(n) for i, n in (("", "constitution"), ("1", "configured"), ("2", "mirror"))))


def _joined_forms(key: DataFrame, bonds: DataFrame, declared: DataFrame, tie: Ties) -> DataFrame:
    """The rows of forms() by joins, for molecules of any size."""
    key = stored(key, "keys")
    every = key.select(*KEY).distinct()
    own = stored(tagged(declared).join(every, KEY, "left_semi"), "declared")
    said = own.select(*KEY).distinct()
    # three colourings of each: as it is, configured, mirrored; without configurations all are the first
    name = every.select(*KEY, F.lit(0).alias("k")).unionByName(said.select(*KEY, F.explode(F.array(F.lit(1), F.lit(2))).alias("k")))
    name = stored(name.select("mol_id", F.col("tag").alias("base"), "k", F.xxhash64("tag", "k").alias("tag")), "names")
    spread = lambda df, *ks: df.withColumnRenamed("tag", "base").join(name.where(F.col("k").isin(*ks)), ["mol_id", "base"]).drop("base", "k")
    both = stored(spread(key, 1, 2).select(*KEY, "site_id", "colour"), "both")
    own, mirrored = stored(spread(own, 1, 2), "both-declared"), name.where("k = 2").select(*KEY)
    got = refined(both, bonds, tie, own, mirrored)
    start = _with(both, signals(own, bonds, got, mirrored))
    start = stored(start.unionByName(spread(key, 0).select(*KEY, "site_id", "colour")), "starts")
    cert = certificates(start, tie).join(name, KEY)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("certificate")))
    return cert.groupBy("mol_id", F.col("base").alias("tag")).agg(pick(0).alias("constitution"), *(F.coalesce(pick(k), pick(0)).alias(n) for k, n in ((1, "configured"), (2, "mirror"))))


def stereoisomers(sites: DataFrame, bonds: DataFrame, geometry: DataFrame, site_key: str = "element", bond_key: str = "bond_order", packed: int = PACKED) -> DataFrame:
    """(mol_id, isomer, locus_kind, locus_id, kind, neighbors): one assignment for each stereoisomer of the constitution;
    a molecule without stereogenic loci has one isomer, with null loci.

    Assignments grow as rows: all open loci whose neighbours are all told apart are assigned at once, else the least
    open one; loci that open only then follow in later rounds.  Assignments of one form are one isomer.
    Their number grows exponentially with the stereogenic loci, as the result does.
    """
    frame = stored(kinds_of(frames(sites, bonds), geometry), "loci")
    plain = sites.select("mol_id").distinct().join(frame, "mol_id", "left_anti").select("mol_id", F.lit(0).cast("long").alias("isomer"))
    tie = ties(sites, bonds, bond_key, packed)
    row, _ = parts(colours(sites, site_key), tie)
    if row is None:
        one = _joined_stereoisomers(sites, bonds, frame, site_key, bond_key, tie)
    else:
        one = _branched(_unsaid(_framed(row, frame)))
        if tie.large is not None:
            one = one.unionByName(_joined_stereoisomers(*(smallgraphs.within(df, tie.large) for df in (sites, bonds, frame)), site_key, bond_key, tie))
    return one.unionByName(plain, allowMissingColumns=True)


def _branched(row: DataFrame) -> DataFrame:
    """The isomers of molecules as rows of arrays, a written table for each round."""
    done = []
    while True:
        step = stored(smallstereo.branches(row), "branches")
        done.append(step.where("done").drop("done"))
        row = step.where("not done").drop("done")
        if row.isEmpty():
            break
    every = stored(_union(done), "assignments")
    one = _forms(every).groupBy("mol_id", "configured").agg(F.min("tag").alias("tag")).select(*KEY)
    given = one.join(every.select(*KEY, "said"), KEY).select("mol_id", F.col("tag").alias("isomer"), F.explode_outer("said").alias("e"))
    return given.select("mol_id", "isomer", *(F.col(f"e.{c}").alias(c) for c in (*LOCUS, "kind", "neighbors")))


def _joined_stereoisomers(sites: DataFrame, bonds: DataFrame, frame: DataFrame, site_key: str, bond_key: str, tie: Ties) -> DataFrame:
    """The rows of stereoisomers() of molecules with loci by joins, for molecules of any size."""
    sites, bonds = _bearing(frame, sites, bonds)
    tie, key = Ties(tie.rows, None, None), stored(colours(sites, site_key), "keys")
    spark = sites.sparkSession
    live = stored(sites.select("mol_id").distinct().withColumn("tag", F.lit(0).cast("long")), "branches")
    given = spark.createDataFrame([], DECLARED)
    done, ready = [], []
    while not live.isEmpty():
        under = lambda df: df.drop("tag").join(live, "mol_id")  # noqa: B023, E731
        colour = settle(stored(under(key), "branch-keys"), bonds, tie, given)
        own = under(frame).join(given.select(*KEY, *LOCUS), [*KEY, *LOCUS], "left_anti")
        found = realizable(stored(own, "open"), colour, tie)
        full = F.size("admitted") == F.col("most")
        most = F.broadcast(spark.createDataFrame([(k.kind, len(k.admitted(list(range(k.slots))))) for k in rotations.kinds()], "kind int, most int"))
        found = stored(found.join(most, "kind").withColumn("full", full), "open-loci")
        least = found.groupBy(*KEY).agg(F.max("full").alias("any"), F.min(F.struct(*LOCUS)).alias("first"))
        now = found.join(least, KEY).where(F.when(F.col("any"), F.col("full")).otherwise(F.struct(*LOCUS) == F.col("first")))
        now = stored(now.select(*KEY, *LOCUS, "kind", F.transform("admitted", lambda o: rotations.through(o, F.col("neighbors"))).alias("ways")), "assign")
        still = now.select(*KEY).distinct()
        done.append(live.join(still, KEY, "left_anti"))
        ready.append(given)
        # mixed radix: the tag of a new branch counts through the ways of its loci, the least locus fastest
        size = now.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*LOCUS, "kind", "ways"))).alias("loci"))
        size = size.withColumn("count", F.aggregate("loci", F.lit(1).cast("long"), lambda n, e: n * F.size(e["ways"])))
        branch = size.select(*KEY, "loci", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("at"))
        start = F.struct(F.col("at").alias("left"), F.array().cast("array<struct<locus_kind:int,locus_id:bigint,kind:int,neighbors:array<bigint>>>").alias("got"))
        step = lambda s, e: F.struct(
            F.floor(s["left"] / F.size(e["ways"])).cast("long").alias("left"),
            F.concat(s["got"], F.array(F.struct(e["locus_kind"].alias("locus_kind"), e["locus_id"].alias("locus_id"), e["kind"].alias("kind"), F.get(e["ways"], (s["left"] % F.size(e["ways"])).cast("int")).alias("neighbors")))).alias("got"),
        )
        new = branch.select("mol_id", F.col("tag").alias("old"), F.xxhash64("tag", "at").alias("tag"), F.aggregate("loci", start, step)["got"].alias("got"))
        new = stored(new, "branches")
        before = given.withColumnRenamed("tag", "old").join(new.select("mol_id", "old", "tag"), ["mol_id", "old"]).select(given.columns)
        more = new.select(*KEY, F.explode("got").alias("e")).select(*KEY, "e.*")
        given = stored(before.unionByName(rotations.configurations(more).select(given.columns)), "given")
        live = new.select(*KEY)
    branch, given = _union(done), _union([g.join(d, KEY, "left_semi") for g, d in zip(ready, done, strict=True)])
    branch, given = stored(branch, "assignments"), stored(given, "assigned")
    form = _joined_forms(colours(sites.join(branch, "mol_id"), site_key), bonds, given, tie)
    one = form.groupBy("mol_id", "configured").agg(F.min("tag").alias("tag")).select(*KEY)
    return one.join(given, KEY, "left").select("mol_id", F.col("tag").alias("isomer"), *LOCUS, "kind", "neighbors")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
