"""Structural similarity of symbols, and clusters of duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeglass.functions.names import is_test_path, is_test_symbol, tokens
from lodeglass.functions.signatures import arity, blend, jaccard, return_type, shape_key, shape_score
from lodeglass.graph.components import connected_components
from lodeglass.operators.listing import in_directory
from lodeglass.storage import discard, materialize

MIN_SIMILAR, MIN_DUPLICATE, BLOCK_CAP, CLUSTER_CAP, LIMIT, PROBES, WIDE = 0.30, 0.90, 64, 64, 10, 1_000, 6
ANY = -2  # stands for any arity


def candidates(exports: DataFrame, members: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Exports and methods (no nested functions, no closure state) with what scores need: name tokens, arity, return type, and the imports
    and dependencies of their file."""
    flat = exports.select("name", "file_path", "start_line", "end_line", "signature", "kind").unionByName(members.where("relationship_kind is null").select(F.col("dotted_name").alias("name"), "file_path", "start_line", "end_line", "signature", "kind"))
    out = flat.select("*", tokens(F.col("name")).alias("tokens"), arity(F.col("signature")).alias("arity"), return_type(F.col("signature")).alias("ret"))
    none = F.array().cast("array<string>")
    if files is None:
        return out.withColumn("near", none)
    near = files.select(F.col("path").alias("file_path"), F.array_distinct(F.array_union(F.coalesce("imports", none), F.coalesce("dependencies", none))).alias("near"))
    return out.join(near, "file_path", "left").withColumn("near", F.coalesce("near", none))


def scored(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds name, shape, kind_score, neighborhood and score to pairs of candidate structs; `a` is the probe. A candidate without signature has shape 0."""
    x, y = F.col(a), F.col(b)
    name = jaccard(x["tokens"], y["tokens"])
    shape = F.when(y["signature"].isNull(), 0.0).otherwise(shape_score(x["arity"], x["ret"], y["arity"], y["ret"]))
    kind = F.when(x["kind"] == y["kind"], 1.0).otherwise(0.0)
    near = F.when((x["file_path"] != y["file_path"]) & (F.size(x["near"]) > 0) & (F.size(y["near"]) > 0), jaccard(x["near"], y["near"]))
    return pairs.withColumns({"name_score": name, "shape_score": shape, "kind_score": kind, "neighborhood": near}).withColumn("score", blend(F.col("name_score"), F.col("shape_score"), F.col("kind_score"), F.col("neighborhood")))


def find_similar(probe: DataFrame, pool: DataFrame, directory: str | None = None, include_tests: bool = False, limit: int = LIMIT) -> DataFrame:
    """The candidates most like one probe (a candidate row): score at least 0.30, by score, name and file. The probe is one row, so it goes to
    every task; the pool does not move but for the top-k."""
    rows = pool.where(in_directory(F.col("file_path"), directory))
    if not include_tests:
        rows = rows.where(~is_test_path(F.col("file_path")) & ~is_test_symbol(F.col("name"), F.col("kind")))
    fields = ["name", "file_path", "start_line", "end_line", "signature", "kind", "tokens", "arity", "ret", "near"]
    one = probe.limit(1).select(F.struct(*fields).alias("a"), F.lit(1).alias("_k"))
    joined = rows.select(F.struct(*fields).alias("b"), F.lit(1).alias("_k")).join(F.broadcast(one), "_k").where((F.col("a.name") != F.col("b.name")) | (F.col("a.file_path") != F.col("b.file_path")))
    out = scored(joined).where(F.col("score") >= MIN_SIMILAR)
    return out.select("b.name", "b.file_path", "b.kind", "name_score", "shape_score", "kind_score", "neighborhood", "score").orderBy(F.desc("score"), "name", "file_path").limit(limit)


def _agreements(rows: DataFrame, side: str, some_far: bool) -> DataFrame:
    """A row for each way in which a row of `rows` (struct `side`, tokens `t`, those to compare `u`, flag `far`) can agree with another one: `k_arity`, `k_ret`, `k_kind` (what both have, or any) and
    `k_tokens` (what both have of `u`, none if these are over `WIDE`), as far as such a pair can score at least 0.30. `k_far`: for probes with a neighbourhood, so of candidates without. Probes (`a`) also
    look for arities beside their own; `w_arity` (0 equal, 1 off by one, 2 neither), `w_ret` and `w_kind` tell what a way stands for."""
    x, probe = F.col(side), side == "a"
    way = lambda value, w: F.struct(value.alias("k"), w.alias("w"))
    every = lambda own, some, rest: F.when(own, F.array(*some, rest)).otherwise(F.array(rest))
    shaped = F.lit(True) if probe else x["signature"].isNotNull()
    near_by = [way(x["arity"] + d, F.lit(abs(d))) for d in ((0, 1, -1) if probe else (0,))]
    ways = {
        "arity": every(shaped & x["arity"].isNotNull(), near_by, way(F.lit(ANY), F.lit(2))),
        "ret": every(shaped, [way(F.coalesce(F.concat(F.lit("="), x["ret"]), F.lit("none")), F.lit(True))], way(F.lit("any"), F.lit(False))),
        "kind": every(x["kind"].isNotNull(), [way(F.concat(F.lit("="), x["kind"]), F.lit(True))], way(F.lit("any"), F.lit(False))),
    }
    out = rows
    for name, options in ways.items():
        out = out.withColumn("_o", F.explode(options)).withColumns({f"k_{name}": F.col("_o.k"), f"w_{name}": F.col("_o.w")}).drop("_o")
    empty = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("u", empty, lambda acc, y: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(y)))))
    out = out.withColumn("k_tokens", F.explode(F.when(F.size("u") <= WIDE, subsets).otherwise(empty)))
    here = F.array(F.lit(False))
    out = out.withColumn("k_far", F.col("far") if probe else F.explode(F.when(~F.col("far") & some_far, F.array(F.lit(False), F.lit(True))).otherwise(here)))
    name = F.when(F.size("k_tokens") > 0, F.size("k_tokens") / F.size("t")).otherwise(0.0)
    shape = (F.when(F.col("w_arity") == 0, 1.0).when(F.col("w_arity") == 1, 0.5).otherwise(0.0) + F.col("w_ret").cast("double")) / 2
    return out.where(blend(name, shape, F.col("w_kind").cast("double"), F.lit(None).cast("double")) >= MIN_SIMILAR)


def find_similar_each(probes: DataFrame, pool: DataFrame, directory: str | None = None, include_tests: bool = False, limit: int = LIMIT) -> DataFrame:
    """`find_similar` for every row of `probes` (candidate rows, told apart by name, file and lines): (probe_name, probe_file, probe_line, ...) with the `limit` best of each.

    Without a neighbourhood, a score follows from what a candidate and the probe agree in: arity, return type, kind and some tokens. So each candidate stands in the lists of all that it can agree in,
    by number of tokens (fewer are better), name and file, and a probe reads the first `limit` names and files of each of its lists, and one more, since one may be its own. Whoever stands before a candidate in
    the list of exactly what it agrees in has its score or a better one, so this is exact, and nothing compares all probes with all candidates. Two kinds of pairs are scored one by one: those of which a
    name has more than `WIDE` tokens and that share a token, and those of which both have a neighbourhood (these in blocks of about `PROBES` probes, by hash).

    Lists are read once for all probes of the same tokens, arity, return type and kind; of what these share, the first `limit` rows of a name and file and the first 2 * `limit` of all hold the best of each, whichever
    name and file is its own. What is exploded is many times what Spark takes it for, which is the size of the file it is read from, so those joins are told to sort and merge: none goes through the driver."""
    rows = pool.where(in_directory(F.col("file_path"), directory))
    if not include_tests:
        rows = rows.where(~is_test_path(F.col("file_path")) & ~is_test_symbol(F.col("name"), F.col("kind")))
    fields = ["name", "file_path", "start_line", "end_line", "signature", "kind", "tokens", "arity", "ret", "near"]
    key = ["name", "file_path", "start_line", "end_line"]
    own = {"t": F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>")))), "far": F.coalesce(F.size("near") > 0, F.lit(False))}
    asked = materialize(probes.select(*fields).dropDuplicates(key).withColumns(own), "probes")
    same = F.struct(F.col("t").alias("tokens"), "far", "kind", "arity", "ret", F.lit(None).cast("string").alias("file_path"), F.array().cast("array<string>").alias("near"))
    probe_rows = asked.select(F.struct(*fields).alias("a"), "far", same.alias("same"))
    xs = asked.select(same.alias("a")).distinct().select("a", F.col("a.tokens").alias("t"), F.col("a.tokens").alias("u"), "a.far")
    n_blocks = -(-asked.where("far").count() // PROBES)
    other = (F.col("a.name") != F.col("b.name")) | (F.col("a.file_path") != F.col("b.file_path"))
    good = lambda pairs: scored(pairs).where(F.col("score") >= MIN_SIMILAR).select("a", "b", "name_score", "shape_score", "kind_score", "neighborhood", "score")

    # of candidates that score alike with every probe, the first by name and file
    alike = ["t", "far", "kind", "arity", "ret", F.col("signature").isNull()]
    one = Window.partitionBy(*alike, "name", "file_path").orderBy("start_line", "end_line", "signature")
    few = rows.select(*fields).withColumns(own).withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= limit)
    few = few.withColumn("_n", F.dense_rank().over(Window.partitionBy(*alike).orderBy("name", "file_path"))).where(F.col("_n") <= limit + 1)
    few = materialize(few.select(F.struct(*fields).alias("b"), "t", "far"), "similar")
    # tokens that no probe has cannot be shared
    known = few.select("t").distinct().withColumn("token", F.explode("t")).join(asked.select(F.explode("t").alias("token")).distinct().hint("merge"), "token").groupBy("t").agg(F.array_sort(F.collect_list("token")).alias("u"))
    ys = materialize(few.join(known, "t", "left").select("b", "t", F.coalesce("u", F.array().cast("array<string>")).alias("u"), "far"), "similar")
    discard(few)

    ways = ["k_arity", "k_ret", "k_kind", "k_tokens", "k_far"]
    listed = _agreements(ys, "b", n_blocks > 0).select(*ways, "b", F.col("u").alias("v"), F.when(F.size("k_tokens") > 0, F.size("t")).otherwise(0).alias("n"))
    order = Window.partitionBy(*ways).orderBy("n", "b.name", "b.file_path")
    listed = listed.withColumn("_n", F.dense_rank().over(order)).where(F.col("_n") <= limit + 1).drop("_n")
    a, b = F.col("a"), F.col("b")
    has = b["signature"].isNotNull()
    exactly = (
        (F.col("w_arity") == F.coalesce(F.when(has & (a["arity"] == b["arity"]), 0).when(has & (F.abs(a["arity"] - b["arity"]) == 1), 1), F.lit(2)))
        & (F.col("w_ret") == (has & a["ret"].eqNullSafe(b["ret"]))) & (F.col("w_kind") == F.coalesce(a["kind"] == b["kind"], F.lit(False)))
        & (F.size("k_tokens") == F.size(F.array_intersect("u", "v")))
    )
    found = [good(_agreements(xs, "a", n_blocks > 0).hint("merge").join(listed, ways).where(exactly))]

    vs = ys.select("b", F.col("u").alias("v"), F.col("far").alias("b_far"))
    wide = lambda c: F.size(c) > WIDE
    for x, y in ((xs.where(wide("u")), vs), (xs.where(~wide("u")), vs.where(wide("v")))):
        shared = x.withColumn("token", F.explode("u")).hint("merge").join(y.withColumn("token", F.explode("v")), "token")
        found.append(good(shared.where(~(F.col("far") & F.col("b_far")) & (F.col("token") == F.array_min(F.array_intersect("u", "v"))))))

    order = [F.desc("score"), "b.name", "b.file_path", "b.start_line", "b.end_line", "b.signature", "b.kind"]
    heads = reduce(DataFrame.union, found).withColumnRenamed("a", "same")
    for whose, n in ((["same", "b.name", "b.file_path"], limit), (["same"], 2 * limit)):
        heads = heads.withColumn("_n", F.row_number().over(Window.partitionBy(*whose).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    found = [probe_rows.select("a", "same").hint("merge").join(heads, "same").where(other).drop("same")]

    each = rows.where(own["far"]).select(F.struct(*fields).alias("b"))
    for i in range(n_blocks):
        block = probe_rows.where("far").where(F.pmod(F.xxhash64(*[f"a.{k}" for k in key]), F.lit(n_blocks)) == i).select("a")
        found.append(good(each.join(F.broadcast(block), other)))
    best = reduce(DataFrame.union, found).withColumn("_n", F.row_number().over(Window.partitionBy(*[F.col(f"a.{k}") for k in key]).orderBy(*order))).where(F.col("_n") <= limit)
    probe = [F.col("a.name").alias("probe_name"), F.col("a.file_path").alias("probe_file"), F.col("a.start_line").alias("probe_line")]
    return best.select(*probe, "b.name", "b.file_path", "b.kind", "name_score", "shape_score", "kind_score", "neighborhood", "score")


def token_frequency(pool: DataFrame) -> DataFrame:
    """(kind, token, freq): in how many candidates of a kind a token of more than one byte occurs."""
    flat = pool.select(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.explode("tokens").alias("token")).where(F.octet_length("token") > 1)
    return flat.groupBy("kind", "token").agg(F.count("*").alias("freq"))


def numbered(pool: DataFrame, directory: str | None = None, kinds: tuple[str, ...] = (), include_tests: bool = False) -> DataFrame:
    """Candidates of the filters, with an id that orders them by file, name and lines."""
    rows = pool.where(in_directory(F.col("file_path"), directory))
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if not include_tests:
        rows = rows.where(~is_test_path(F.col("file_path")) & ~is_test_symbol(F.col("name"), F.col("kind")))
    key = F.struct("file_path", "name", F.coalesce("start_line", F.lit(-1)).alias("s"), F.coalesce("end_line", F.lit(-1)).alias("e"))
    return rows.withColumn("key", key)


def block_keys(rows: DataFrame) -> DataFrame:
    """(key, block, shape): the two rarest tokens of each candidate with its shape, or the shape alone; all within the kind."""
    kind = F.coalesce("kind", F.lit("unknown"))
    shape = shape_key(F.col("signature"))
    flat = rows.select("key", kind.alias("kind"), shape.alias("shape"), F.col("signature").isNotNull().alias("has"), F.explode_outer(F.filter("tokens", lambda t: F.octet_length(t) > 1)).alias("token"))
    ranked = flat.join(token_frequency(rows), ["kind", "token"], "left").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("freq", "token")))
    by_token = ranked.where("token is not null and _n <= 2").select("key", F.concat_ws("|", F.lit("token"), "kind", "token", F.when(F.col("has"), F.col("shape")).otherwise("")).alias("block"), "shape")
    by_shape = rows.where(F.size(F.filter("tokens", lambda t: F.octet_length(t) > 1)) == 0).select("key", F.concat_ws("|", F.lit("shape"), kind, shape).alias("block"), shape.alias("shape"))
    return by_token.union(by_shape)


def candidate_pairs(blocks: DataFrame, cap: int = BLOCK_CAP) -> tuple[DataFrame, DataFrame]:
    """(pairs of keys, a < b, once each; overflowing blocks with their size). A block over the cap is split by shape, and what is still over it
    keeps its first `cap` members: the reference semantics of this operator, reported as `block_overflow`."""
    size = F.count("*").over(Window.partitionBy("block"))
    sized = blocks.withColumn("size", size)
    small = sized.where(F.col("size").between(2, cap)).select("key", "block")
    split = sized.where(F.col("size") > cap).select("key", F.concat_ws("|", "block", "shape").alias("block")).withColumn("size", size)
    ranked = split.withColumn("_n", F.row_number().over(Window.partitionBy("block").orderBy("key")))
    kept = small.union(ranked.where((F.col("size") >= 2) & (F.col("_n") <= cap)).select("key", "block"))
    overflow = split.where(F.col("size") > cap).groupBy("block").agg(F.count("*").alias("size"))
    lists = kept.groupBy("block").agg(F.array_sort(F.collect_list("key")).alias("l"))  # at most `cap` long
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct(), overflow


def dupe_clusters(pool: DataFrame, min_score: float = MIN_DUPLICATE, limit: int = LIMIT, **filters) -> dict[str, DataFrame]:
    """clusters (cluster, score, size, first), members (cluster, name, file_path, start_line, kind) and diagnostics (code, what, size)."""
    rows = materialize(numbered(pool, **filters), "dupes")
    pairs, overflow = candidate_pairs(block_keys(rows))
    fields = ["name", "file_path", "start_line", "end_line", "signature", "kind", "tokens", "arity", "ret", "near"]
    side = lambda n: rows.select(F.col("key").alias(n + "_key"), F.struct(*fields).alias(n))
    joined = pairs.select(F.col("a").alias("a_key"), F.col("b").alias("b_key")).join(side("a"), "a_key").join(side("b"), "b_key")
    text = lambda c: F.concat_ws("\x1f", c["file_path"], c["name"], F.lpad(c["s"].cast("string"), 12, "0"), F.lpad(c["e"].cast("string"), 12, "0"))
    links = materialize(scored(joined).where(F.col("score") >= min_score).select(text(F.col("a_key")).alias("a"), text(F.col("b_key")).alias("b"), "score"), "links")
    comp = materialize(connected_components(links), "components")
    best = links.join(comp, F.col("a") == F.col("node")).groupBy("component").agg(F.max("score").alias("score"))
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    clusters = best.join(sizes, "component").where("size >= 2")
    kept = clusters.where(F.col("size") <= CLUSTER_CAP).orderBy(F.desc("score"), F.desc("size"), "component").limit(limit).withColumnRenamed("component", "cluster")
    named = rows.withColumn("node", text(F.col("key"))).join(comp, "node").join(kept.select(F.col("cluster").alias("component")), "component", "left_semi").select(F.col("component").alias("cluster"), "name", "file_path", "start_line", "kind")
    diagnostics = overflow.select(F.lit("block_overflow").alias("code"), F.col("block").alias("what"), "size").union(clusters.where(F.col("size") > CLUSTER_CAP).select(F.lit("cluster_overflow"), "component", "size"))
    return {"clusters": kept, "members": named, "diagnostics": diagnostics, "pairs": links}
