"""Re-exports: what a name that a package hands on finally stands for.

A name of a package is a state. A named export leads to one other state, a star export to the same name in its source;
several stars are tried in order. States with one way on form chains, which are followed by doubling, so a chain of n
links takes log2(n) rounds; states with several ways are decided afterwards, in as many rounds as they are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .forest import _doubling
from .skew import lookup
from .structure import cycle_nodes


def _state(package: str, name: str):
    """One string for a state."""
    return F.concat(F.length(package).cast("string"), F.lit(":"), F.col(package), F.lit("."), F.col(name))


def _direct(ways: DataFrame, symbols: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``ways(to_package, to_name)`` with ``direct``: the symbol of that name in that module, by its qualified name or else in the module's file."""
    own = symbols.where("kind <> 'module'")
    exact = own.groupBy(F.col("fqn").alias("_fqn")).agg(F.min("id").alias("_exact"))
    module = symbols.where("kind = 'module'").groupBy(F.col("fqn").alias("to_package")).agg(F.min(F.struct("id", "file"))["file"].alias("_file"))
    inside = own.where("file is not null").groupBy(F.col("file").alias("_file"), F.col("name").alias("to_name")).agg(F.min("id").alias("_inside"))
    held = scratch.save(ways.withColumn("_fqn", F.concat_ws(".", "to_package", "to_name")), f"{name}-asked")
    found = scratch.save(lookup(lookup(held, exact, ["_fqn"], among=held), module, ["to_package"], among=held), f"{name}-modules")
    found = lookup(found, inside, ["_file", "to_name"], among=found)
    return found.select(*ways.columns, F.coalesce("_exact", "_inside").alias("direct"))


def _anywhere(named: DataFrame, symbols: DataFrame) -> DataFrame:
    """``named(package, original)`` with ``fallback``: the first symbol of that name anywhere below the package."""
    parts = F.split("fqn", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    below = symbols.where("kind <> 'module' and contains(fqn, '.')").select("id", F.col("name").alias("original"), F.explode(prefixes).alias("package"))
    first = below.groupBy("package", "original").agg(F.min("id").alias("fallback"))
    return lookup(named, first, ["package", "original"])


def re_exports(exports: DataFrame, symbols: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(package, name, symbol, fqn, state) of every named export, or of each of ``asked(package, name)``.

    ``exports(package, name, source, original, ordinal)``: ``package`` hands on ``original`` of ``source`` as ``name``; a
    null name is a star, of all names. Of exports of one name the last by ordinal counts. ``symbols(id, fqn, name, kind,
    file)``: the smallest id counts among several. A named export is looked for in its source, then by the source's own
    exports, then anywhere below the package; stars are tried in order, each in its source and then by the source's
    exports. ``state`` is resolved, unresolved, or ring where the way runs into a ring and nothing was found on it. In a
    ring of packages with several stars, a star that leads back is passed over. Chains have any length.
    """
    spark = exports.sparkSession
    scratch = Scratch(spark, "re-exports")
    last = exports.where("package is not null and name is not null").groupBy("package", "name").agg(F.max(F.struct("ordinal", "source", "original")).alias("e"))
    named = scratch.save(last.select("package", "name", F.col("e.source").alias("source"), F.coalesce("e.original", "name").alias("original")), "named")
    stars = scratch.save(exports.where("package is not null and name is null and source is not null").groupBy("package", "source").agg(F.min("ordinal").alias("ordinal")), "stars")
    wanted = named.select("package", "name") if asked is None else asked.select("package", "name").where("package is not null and name is not null").distinct()
    # States that stars lead to, from the names asked for and those that named exports lead to.
    handing, known = stars.select("package").distinct(), named.select("package", "name")
    reach = wanted.union(named.where("source is not null").select("source", "original")).distinct()
    frontier = scratch.save(reach.join(known, ["package", "name"], "left_anti").join(handing, "package", "left_semi"), "reach-0")
    names, n = ["reach-0"], 0
    while not frontier.isEmpty():
        n += 1
        seen = scratch.together(names, frontier)
        onward = frontier.join(stars, "package").select(F.col("source").alias("package"), "name").distinct()
        fresh = onward.join(known, ["package", "name"], "left_anti").join(seen, ["package", "name"], "left_anti").join(handing, "package", "left_semi")
        frontier = scratch.save(fresh, f"reach-{n}")
        names.append(f"reach-{n}")
    open_states = scratch.together(names, frontier)
    by_name = _anywhere(named, symbols).select("package", "name", F.lit(0).alias("rank"), F.col("source").alias("to_package"), F.col("original").alias("to_name"), "fallback")
    place = F.row_number().over(Window.partitionBy("package").orderBy("ordinal", "source"))
    by_star = open_states.join(stars.withColumn("rank", place), "package").select("package", "name", "rank", F.col("source").alias("to_package"), F.col("name").alias("to_name"), F.lit(None).cast(symbols.schema["id"].dataType).alias("fallback"))
    ways = _direct(by_name.unionByName(by_star), symbols, scratch, "ways").withColumns({"id": _state("package", "name"), "to": _state("to_package", "to_name")})
    ways = scratch.save(ways, "ways")
    many = scratch.save(ways.groupBy("id").agg(F.count("*").alias("n")), "states")
    led = lookup(ways, many.select(F.col("id").alias("to"), (F.col("n") > 1).alias("to_fork")), ["to"])
    led = led.join(many, "id").withColumn("to_fork", F.when(F.col("direct").isNull(), F.col("to_fork")))
    led = scratch.save(led.select("id", "rank", "direct", "fallback", "n", F.when(~F.col("to_fork"), F.col("to")).alias("anc"), F.when(F.col("to_fork"), F.col("to")).alias("fork")), "led")

    def climb(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("_anc").alias("anc"), F.coalesce("direct", "_direct").alias("direct"), F.coalesce("_fallback", "fallback").alias("fallback"), F.col("_fork").alias("fork"))

    chains = _doubling(led.where("n = 1").select("id", "anc", "direct", "fallback", "fork"), scratch, "chains", climb, ["direct", "fallback", "fork"])
    ringed = F.col("anc").isNotNull()
    # A chain gives a symbol, or what a fork gives and else its deepest fallback, or nothing.
    ends = scratch.save(chains.select("id", F.when(~ringed, F.coalesce("direct", F.when(F.col("fork").isNull(), F.col("fallback")))).alias("symbol"), F.when(~ringed, F.col("fork")).alias("fork"), F.when(~ringed, F.col("fallback")).alias("fallback"), ringed.alias("ring")), "ends")
    forks = _decide(led.where("n > 1"), ends, scratch)
    settled = lookup(ends, forks.select(F.col("id").alias("fork"), F.col("symbol").alias("_given"), F.col("ring").alias("_ring")), ["fork"])
    chosen = F.coalesce("symbol", "_given", F.when(F.col("fork").isNotNull(), F.col("fallback")))
    of_chains = settled.select("id", chosen.alias("symbol"), (F.col("ring") | F.coalesce("_ring", F.lit(False))).alias("ring"))
    values = scratch.save(of_chains.unionByName(forks.select("id", "symbol", "ring")), "values")
    out = wanted.withColumn("id", _state("package", "name")).join(values, "id", "left").select("package", "name", "symbol", "ring")
    out = scratch.save(out, "reached")
    # A name that nothing exports may still be the package's own.
    alone = out.where("ring is null").select("package", "name", F.col("package").alias("to_package"), F.col("name").alias("to_name"))
    own = _direct(alone, symbols, scratch, "own").select("package", "name", F.col("direct").alias("symbol"), F.lit(False).alias("ring"))
    found = scratch.save(out.where("ring is not null").unionByName(own), "found")
    titled = lookup(found, symbols.groupBy(F.col("id").alias("symbol")).agg(F.min("fqn").alias("fqn")), ["symbol"], among=found)
    state = F.when(F.col("symbol").isNotNull(), "resolved").when(F.col("ring"), "ring").otherwise("unresolved")
    return titled.select("package", "name", "symbol", "fqn", state.alias("state"))


def _decide(ways: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, symbol, ring) of states with several ways: the first that gives a symbol, each asked only when those before it give none."""
    through = lookup(ways.select("id", "rank", "direct", "anc", "fork"), ends.select(F.col("id").alias("anc"), F.col("symbol").alias("_s"), F.col("fork").alias("_f"), F.col("fallback").alias("_b"), F.col("ring").alias("_r")), ["anc"])
    held = through.select("id", "rank", F.coalesce("direct", "_s").alias("symbol"), F.when(F.coalesce("direct", "_s").isNull(), F.coalesce("fork", "_f")).alias("fork"), F.when(F.col("fork").isNull(), F.col("_b")).alias("fallback"), F.coalesce("_r", F.lit(False)).alias("ring"))
    held = scratch.save(held, "fork-ways")
    done, k, force = None, 0, False
    none = held.select("id", "symbol", "ring").limit(0)
    done = none
    while True:
        rows = lookup(held, done.select(F.col("id").alias("fork"), F.col("symbol").alias("_given"), F.lit(True).alias("_known")), ["fork"])
        waits = F.col("symbol").isNull() & F.col("fork").isNotNull() & F.col("_known").isNull()
        gives = F.coalesce("symbol", F.when(F.col("_known"), F.coalesce("_given", "fallback")))
        # The first way that gives a symbol, and the first that still waits.
        state = rows.groupBy("id").agg(F.min(F.when(gives.isNotNull(), F.struct("rank", gives.alias("symbol")))).alias("found"), F.min(F.when(waits, F.col("rank"))).alias("waiting"), F.max("ring").alias("ring"))
        state = state.join(done.select("id"), "id", "left_anti")
        ready = F.col("waiting").isNull() | (F.col("found.rank") < F.col("waiting")) | (F.col("found").isNotNull() if force else F.lit(False))
        now = scratch.save(state.where(ready).select("id", F.col("found.symbol").alias("symbol"), (F.col("found").isNull() & F.col("ring")).alias("ring")), f"decided-{k}")
        k += 1
        if now.isEmpty():
            if force:
                rest = scratch.save(state.select("id", F.lit(None).cast(held.schema["symbol"].dataType).alias("symbol"), F.lit(True).alias("ring")), "on-rings")
                return done.unionByName(rest)
            force = True
            continue
        done, force = scratch.together([f"decided-{j}" for j in range(k)], now), False


def export_violations(exports: DataFrame) -> DataFrame:
    """(severity, code, package, name), all warnings: DUPLICATE_EXPORT, MISSING_SOURCE_MODULE (a named export without source) and CYCLIC_EXPORT (a package on a ring)."""
    said = exports.where("package is not null")
    say = lambda code: (F.lit("warning").alias("severity"), F.lit(code).alias("code"))
    twice = said.where("name is not null").groupBy("package", "name").count().where("count > 1").select(*say("DUPLICATE_EXPORT"), "package", "name")
    lost = said.where("source is null and name is not null").select(*say("MISSING_SOURCE_MODULE"), "package", "name").distinct()
    links = said.where("source is not null and source <> package").select(F.col("package").alias("src"), F.col("source").alias("dst")).distinct()
    rings = cycle_nodes(links).select(*say("CYCLIC_EXPORT"), F.col("node").alias("package"), F.lit(None).cast("string").alias("name"))
    return twice.union(lost).union(rings)
