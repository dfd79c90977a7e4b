"""Typed edges from parsed records: calls, imports, inheritance, dependencies, services, middleware and tables by names and by words in the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import lookup

#: Values of one name that stand in one row, about; pairs that a task makes, about.
PART, TASK = 4_000, 20_000_000
#: Call names that say nothing about a target, bases that need no node, functions that check who asks.
IGNORED_CALLS = ("get", "post", "put", "delete", "patch", "append", "extend", "add", "commit", "execute", "query", "update", "pop", "remove", "keys", "values", "items")
PLAIN_BASES = ("BaseModel", "object")
AUTH_FUNCTIONS = ("get_current_user", "verify_token", "require_admin", "get_current_active_user")
#: What the lower-cased code is searched for, and the node that it stands for.
SERVICES = (
    ("groq(", "Groq"),
    ("groq_client", "Groq"),
    ("generate_node_summary", "Groq"),
    ("github(", "GitHub"),
    ("get_github_token", "GitHub"),
    ("clone_github_repo", "GitHub"),
    ("redis(", "Redis"),
    ("redis.", "Redis"),
    ("create_client(", "Supabase"),
    ("supabase.", "Supabase"),
    ("openai(", "OpenAI"),
)
EXTERNAL_APIS = (
    ("api.github.com", "GitHub API"),
    ("api.groq.com", "Groq API"),
    ("api.openai.com", "OpenAI API"),
    ("api.stripe.com", "Stripe API"),
    ("httpx.get", "External HTTP"),
    ("httpx.post", "External HTTP"),
    ("httpx.put", "External HTTP"),
    ("httpx.delete", "External HTTP"),
    ("httpx.patch", "External HTTP"),
    ("requests.get", "External HTTP"),
    ("requests.post", "External HTTP"),
    ("aiohttp.clientsession", "External HTTP"),
)
MIDDLEWARE = (
    ("corsmiddleware", "CORSMiddleware"),
    ("authmiddleware", "AuthMiddleware"),
    ("loggingmiddleware", "LoggingMiddleware"),
    ("httpsredirectmiddleware", "HTTPSRedirectMiddleware"),
    ("trustedhostmiddleware", "TrustedHostMiddleware"),
    ("gzipmiddleware", "GZipMiddleware"),
)
#: Model names in lower case and their tables; words that a FROM clause never means.
MODEL_TABLES = (("repo", "repos"), ("repofile", "repo_files"), ("node", "nodes"), ("edge", "edges"), ("foldertree", "folder_trees"), ("user", "users"))
NO_TABLES = ("select", "from", "where", "and", "or", "not")
CONTAINED = ("function", "class", "api_route", "method")


def _short(name: str) -> Column:
    return F.substring_index(name, ".", -1)


def _labels(code: Column, patterns) -> Column:
    """Distinct labels of the patterns that a text contains."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(code.contains(p), label) for p, label in patterns))))


def _tagged(tables: Column, kind: str) -> Column:
    return F.transform(tables, lambda t: F.struct(F.lit(kind).alias("type"), t.alias("t")))


def normal_path(parts: Column) -> Column:
    """An array of path parts without empty ones, ``.`` and ``..``; what leads above the top is left out."""
    step = lambda done, x: F.when((x == "") | (x == "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(id, file, said)`` to (id, said, target): the file of ``files(file)`` that an import means.

    Relative paths are tried as they are and with the endings of scripts; dotted names as a module or package, then their
    parents, then any Python file whose dotted path begins with the name (the smallest). Names with a slash or ``@`` have
    no file.
    """
    said = F.regexp_replace(F.trim("said"), "/+$", "")
    # What a file says is looked for once, however many records say it.
    rows = imports.select("file", "said").distinct().withColumn("_said", said).where("_said is not null and _said <> ''").withColumn("_row", F.monotonically_increasing_id())
    folder = F.slice(F.split("file", "/"), F.lit(1), F.size(F.split("file", "/")) - 1)
    raw = F.array_join(normal_path(F.concat(folder, F.split("_said", "/"))), "/")
    relative = F.array(*(F.concat(raw, F.lit(e)) for e in ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")))
    parts = F.split(F.translate("_said", ".", "/"), "/")
    parents = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dotted = F.flatten(F.transform(parents, lambda p: F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))))
    plain = ~F.col("_said").contains("/") & ~F.col("_said").startswith("@")
    tries = F.when(F.col("_said").startswith("."), relative).when(plain, dotted).otherwise(F.array().cast("array<string>"))
    known = files.select(F.col("file").alias("target")).distinct()
    found = rows.select("_row", F.posexplode(tries).alias("rank", "target")).join(known, "target").groupBy("_row").agg(F.min(F.struct("rank", "target"))["target"].alias("target"))
    exact = rows.join(found, "_row", "left")
    python = known.where(F.col("target").endswith(".py")).select("target", F.translate("target", "/", ".").alias("path"))
    begins = python.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("_said"))
    first = begins.groupBy("_said").agg(F.min("target").alias("_partial"))
    out = exact.join(first, "_said", "left")
    target = F.coalesce("target", F.when(plain & ~F.col("_said").startswith("."), F.col("_partial")))
    found = out.select("file", "said", target.alias("target")).where("target is not null")
    return lookup(imports, found, ["file", "said"]).select("id", "said", "target").where("target is not null")


def _pairs(said: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, type), each once, of ``said(src, said, type)`` with all of ``names(said, dst)`` of the name.

    The result may grow with the square of the input, so it isn't shuffled: sources and targets of a name are dealt into parts of about
    PART values, each part of the one meets each of the other in one task, and only there pairs are made. Spark holds what one row of a
    join explodes into until all of it is made, so a row is one source and the array of one part of the targets, never a part of both.
    A pair comes up once where its target has one name; few have several.
    """
    said = said.where("src is not null").distinct()
    of = names.where("dst is not null").groupBy("dst").agg(F.min("said").alias("said"), F.max("said").alias("_last"))
    alone, several = of.where("said = _last").select("said", "dst"), names.join(of.where("said <> _last").select("dst"), "dst", "left_semi")
    number = lambda rows, n: rows.groupBy("said").agg(F.count("*").alias(n))
    counts = Scratch(said.sparkSession, "pairs").save(number(said, "_n").join(number(alone, "_m"), "said"), "counts")
    total = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
    parts = counts.select("said", "_n", "_m", F.ceil(F.col("_n") / PART).alias("_srcs"), F.ceil(F.col("_m") / PART).alias("_dsts"))
    part = lambda value, of: F.pmod(F.xxhash64(value), of)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    keys = ["said", "_src", "_dst"]
    sources = lookup(said, parts.drop("_m"), ["said"], "_n").where("_dsts is not null").select("src", "type", "said", part("src", "_srcs").alias("_src"), every("_dsts").alias("_dst"))
    targets = lookup(alone, parts.drop("_n"), ["said"], "_m").where("_dsts is not null").select("dst", "said", part("dst", "_dsts").alias("_dst"), every("_srcs").alias("_src"))
    if total > TASK:
        tasks = max(int(min(total / TASK, 20_000)) + 1, int(said.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sources, targets = sources.repartition(tasks, *keys), targets.repartition(tasks, *keys)
    # A merge join goes by the rows on its left; a hash join might go by the arrays, and hold the pairs of a whole part.
    both = sources.join(targets.groupBy(*keys).agg(F.collect_list("dst").alias("dsts")).hint("merge"), keys)
    pairs = both.select("src", F.explode("dsts").alias("dst"), "type")
    return pairs.union(said.join(several, "said").select("src", "dst", "type").distinct())


def typed_edges(records: DataFrame, files: DataFrame, services=SERVICES, apis=EXTERNAL_APIS, middleware=MIDDLEWARE, models=MODEL_TABLES, auth=AUTH_FUNCTIONS) -> DataFrame:
    """Distinct (src, dst, type) of ``records(id, name, node_type, file, calls, imports, bases, depends_on, code)`` and ``files(file)``.

    Names are short names (behind the last dot). A call or a base goes to all nodes of its name; an import, a dependency
    to the first by id. ``calls`` (from interfaces ``api_calls``), ``imports``, ``class_contains``, ``inherits``,
    ``auth_dependency`` and ``dependency_injection``; by words in the code ``uses_service``, ``external_api``,
    ``middleware_dependency`` and the four table operations; ``contains`` from a file to what it defines. What the
    records lack is named for its kind: ``_ext_``, ``_auth_``, ``_di_``, ``__svc__``, ``__api__``, ``__mw__``, ``__table__``.
    """
    names = records.select(_short("name").alias("said"), F.col("id").alias("dst"))
    first = names.groupBy("said").agg(F.min("dst").alias("dst"))
    edge = lambda df, kind: df.select("src", "dst", kind if isinstance(kind, Column) else F.lit(kind).alias("type"))
    each = lambda column, *more: records.select(F.col("id").alias("src"), F.explode(F.array_distinct(column)).alias("said"), *more)
    calls = each("calls", F.when(F.col("node_type") == "api_route", "api_calls").otherwise("calls").alias("type")).where(~F.col("said").isin(*IGNORED_CALLS))
    made, out = [_pairs(calls.select("src", "said", "type"), names).where("src <> dst")], []
    said = records.select("id", "file", F.explode("imports").alias("said"))
    at = records.groupBy(F.col("file").alias("target")).agg(F.min("id").alias("dst"))
    out.append(edge(import_files(said, files).join(at, "target").withColumnRenamed("id", "src"), "imports"))
    methods = records.where((F.col("node_type") == "method") & F.col("name").contains("."))
    out.append(edge(methods.select(F.concat("file", F.lit(":"), F.substring_index("name", ".", 1)).alias("src"), F.col("id").alias("dst")), "class_contains"))
    bases = each("bases", "node_type").where("node_type = 'class'").select("src", "said", F.lit("inherits").alias("type"))
    made.append(_pairs(bases, names))
    lacking = lookup(bases, first, ["said"]).where(F.col("dst").isNull() & ~F.col("said").isin(*PLAIN_BASES))
    out.append(edge(lacking.withColumn("dst", F.concat(F.lit("_ext_"), "said")), "inherits"))
    checks = F.col("said").isin(*auth)
    depends = lookup(each("depends_on"), first, ["said"]).withColumn("dst", F.coalesce("dst", F.concat(F.when(checks, "_auth_").otherwise("_di_"), "said")))
    out.append(edge(depends, F.when(checks, "auth_dependency").otherwise("dependency_injection").alias("type")))
    coded = records.where("code is not null and code <> ''").select(F.col("id").alias("src"), F.lower("code").alias("code"))
    for patterns, lead, kind in ((services, "__svc__", "uses_service"), (apis, "__api__", "external_api"), (middleware, "__mw__", "middleware_dependency")):
        seen = coded if kind != "middleware_dependency" else coded.where(F.col("code").contains("middleware"))
        out.append(edge(seen.select("src", F.explode(_labels(F.col("code"), patterns)).alias("l")).select("src", F.concat(F.lit(lead), "l").alias("dst")), kind))
    code = F.col("code")
    operations = []
    for model, table in models:
        used, of = code.contains(model), lambda kind, t=table: F.struct(F.lit(kind).alias("type"), F.lit(t).alias("t"))
        operations += [F.when(code.contains(f"select({model}"), of("reads_table")), F.when(used & (code.contains("db.add") | code.contains("session.add")), of("writes_table")), F.when(used & code.contains("update"), of("updates_table")), F.when(used & code.contains("delete("), of("deletes_table"))]
    written = []
    for pattern, kind in ((r"(?s)select\b.*?\bfrom\s+(\w+)", "reads_table"), (r"insert\s+into\s+(\w+)", "writes_table"), (r"update\s+(\w+)\s+set", "updates_table"), (r"delete\s+from\s+(\w+)", "deletes_table")):
        found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
        if kind == "reads_table":
            found = F.filter(found, lambda t: ~t.isin(*NO_TABLES))
        written.append(_tagged(found, kind))
    tables = coded.select("src", F.explode(F.array_distinct(F.concat(F.array_compact(F.array(*operations)), *written))).alias("o"))
    out.append(tables.select("src", F.concat(F.lit("__table__"), "o.t").alias("dst"), F.col("o.type").alias("type")))
    inside = records.where(F.col("node_type").isin(*CONTAINED)).join(files.select("file").distinct(), "file", "left_semi")
    out.append(edge(inside.select(F.col("file").alias("src"), F.col("id").alias("dst")), "contains"))
    return reduce(DataFrame.union, made, reduce(DataFrame.union, out).distinct())


#: Node types of what the records lack, by the beginning of its id.
GENERIC = (("__svc__", "service"), ("__api__", "external_api"), ("__mw__", "middleware"), ("__table__", "database_table"), ("_ext_", "class"), ("_auth_", "function"), ("_di_", "function"))


def generic_nodes(edges: DataFrame) -> DataFrame:
    """(id, name, node_type) of the targets that no record describes."""
    kind, name = F.lit(None).cast("string"), F.col("dst")
    for lead, node_type in reversed(GENERIC):
        kind = F.when(F.col("dst").startswith(lead), node_type).otherwise(kind)
        name = F.when(F.col("dst").startswith(lead), F.substring(F.col("dst"), len(lead) + 1, 1 << 20)).otherwise(name)
    return edges.select("dst").distinct().select(F.col("dst").alias("id"), name.alias("name"), kind.alias("node_type")).where("node_type is not null")
