"""Reconciliation of declared and actual files, path and content rules, exact result diffs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialize

# File endings that must not be published.
FORBIDDEN_EXTENSIONS = (".key", ".pcap", ".pcapng", ".edge-update")

# Content patterns; mailboxes and placeholder names are added by the user.
CONTENT_RULES = {
    "host user path": r"(?i)[a-z]:[\\/]+users[\\/]+",
    "GitHub access token": r"(?:gh[opsu]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})",
    "AWS access key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}


def reconcile(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """``(path, status)`` of every file either side knows; statuses follow the order of checking."""
    d = declared.select("path", F.col("bytes").alias("_db"), F.col("sha256").alias("_dh"), F.lit(1).alias("_d"))
    a = actual.select("path", F.col("bytes").alias("_ab"), F.col("sha256").alias("_ah"), F.lit(1).alias("_a"))
    status = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_d").isNull(), "unexpected")
        .when(~F.col("_db").eqNullSafe(F.col("_ab")), "size mismatch")
        .when(~F.col("_dh").eqNullSafe(F.col("_ah")), "hash mismatch")
        .otherwise("ok")
    )
    return d.join(a, "path", "full_outer").select(
        "path", status.alias("status"), F.col("_db").alias("declared_bytes"), F.col("_ab").alias("actual_bytes")
    )


def path_rules(
    files: DataFrame,
    prefixes: Sequence[str],
    exact: Sequence[str],
    extensions: Sequence[str] = FORBIDDEN_EXTENSIONS,
    path: str = "path",
) -> DataFrame:
    """One row per violated kind of rule: forbidden prefix, exact path or (any case) extension."""
    p = F.col(path)
    lower = F.lower(p)

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    kinds = F.array_compact(
        F.array(
            F.when(any_of([p.startswith(x) for x in prefixes]), "prefix"),
            F.when(p.isin(list(exact)), "exact path"),
            F.when(any_of([lower.endswith(x.lower()) for x in extensions]), "extension"),
        )
    )
    return files.withColumn("rule", F.explode(kinds))


def sensitive_scan(
    documents: DataFrame, text: str, rules: Mapping[str, str] = CONTENT_RULES, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per document and violated content rule.

    Each text is read once and tested against every pattern in place; only labels are exploded.
    """
    found = F.array_compact(F.array(*[F.when(F.rlike(F.col(text), F.lit(r)), n) for n, r in rules.items()]))
    return documents.select(*keep, F.explode(found).alias("rule"))


def scan_files(documents: DataFrame, content: str = "content", **kwargs) -> DataFrame:
    """Content rules over raw bytes; Latin-1 maps every byte to one character."""
    return sensitive_scan(documents.withColumn("_text", F.decode(content, "ISO-8859-1")), "_text", **kwargs)


def artifact_verify(
    declared: DataFrame,
    actual: DataFrame,
    prefixes: Sequence[str],
    exact: Sequence[str],
    contents: DataFrame | None = None,
    rules: Mapping[str, str] = CONTENT_RULES,
    file_count: int | None = None,
    total_bytes: int | None = None,
) -> DataFrame:
    """Every finding of a full verification as ``(path, finding)``; an empty result passes."""
    found = reconcile(declared, actual).filter(F.col("status") != "ok").select("path", F.col("status").alias("finding"))
    broken = path_rules(actual.select("path"), prefixes, exact).select(
        "path", F.concat(F.lit("forbidden "), "rule").alias("finding")
    )
    out = found.unionByName(broken)
    if contents is not None:
        hits = scan_files(contents, rules=rules, keep=["path"])
        out = out.unionByName(hits.select("path", F.concat(F.lit("forbidden "), "rule").alias("finding")))
    totals = actual.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    for column, expected, finding in (("n", file_count, "file_count mismatch"), ("b", total_bytes, "total_bytes mismatch")):
        if expected is not None:
            bad = totals.filter(F.col(column) != expected)
            out = out.unionByName(bad.select(F.lit("").alias("path"), F.lit(finding).alias("finding")))
    return out


NODES = "path string, steps array<struct<index:int,member:string>>, type string, value string"
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "double", type(None): "null"}
PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _nodes(document: str) -> Iterator[tuple]:
    """Path, steps, type and value of every node of one JSON document, containers included."""
    todo = [("$", (), json.loads(document))]
    while todo:
        path, steps, node = todo.pop()
        if isinstance(node, dict):
            yield path, steps, "object", json.dumps(sorted(node), ensure_ascii=False, separators=(",", ":"))
            for name, child in node.items():
                inner = f".{name}" if PLAIN_NAME.fullmatch(name) else f"[{json.dumps(name, ensure_ascii=False)}]"
                todo.append((path + inner, (*steps, (None, name)), child))
        elif isinstance(node, list):
            yield path, steps, "array", str(len(node))
            todo += [(f"{path}[{i}]", (*steps, (i, None)), child) for i, child in enumerate(node)]
        else:
            value = node + 0.0 if isinstance(node, float) else node  # no negative zero
            yield path, steps, KINDS[type(node)], json.dumps(value, ensure_ascii=False)


def flatten_json(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, path, steps, type, value)`` of every node of a JSON text, at any depth.

    Each document is parsed once, inside its task. Integers keep all their digits, and an integer and a
    double of equal value stay different types. Names other than plain ones are quoted in ``path``, so
    no two nodes share one; ``steps`` sorts in document order (list items by number, members by name).
    Of repeated names the last counts. A null text has no nodes; a text that is no JSON fails the query.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *node) for k, document in zip(batch[key], batch[text]) if document is not None for node in _nodes(document)]
            yield pd.DataFrame(rows, columns=[key, "path", "steps", "type", "value"])

    narrow = documents.select(key, text)
    return narrow.mapInPandas(walk, f"{key} {narrow.schema[key].dataType.simpleString()}, {NODES}")


#: Levels that one pass over nested documents opens before it is written.
LEVELS_PER_PASS = 8


def _step(index: Column, member: Column) -> Column:
    return F.struct(index.cast("int").alias("index"), member.cast("string").alias("member"))


def _member_tail(name: Column) -> Column:
    return F.when(name.rlike(f"^{PLAIN_NAME.pattern}$"), F.concat(F.lit("."), name)).otherwise(F.to_json(F.array(name)))


def _item_tail(index: Column) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("]"))


def _members(v: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$', 'map<string,variant>')")


def _items(v: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$', 'array<variant>')")


def _kind_and_value(v: str, members: str, items: str) -> tuple[Column, Column]:
    """Type and value of the node in column ``v``, whose members and items were taken out."""
    number = F.expr(f"CAST({v} AS DOUBLE)") + F.lit(0.0)
    tag = F.expr(f"schema_of_variant({v})")
    # More than 18 digits are a decimal without places; fewer with a point in the text are one too, but a double.
    whole = (tag == "BIGINT") | tag.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$")
    scalar = (
        F.when(F.expr(f"is_variant_null({v})"), F.lit("null")).when(tag == "STRING", "string").when(tag == "BOOLEAN", "boolean")
        .when(whole, "integer").otherwise("double")
    )
    kind = F.when(F.col(members).isNotNull(), "object").when(F.col(items).isNotNull(), "array").otherwise(scalar)
    value = (
        F.when(F.col(members).isNotNull(), F.to_json(F.array_sort(F.map_keys(members))))
        .when(F.col(items).isNotNull(), F.size(items).cast("string"))
        .when(tag == "DOUBLE", number.cast("string")).when(tag.startswith("DECIMAL") & ~whole, number.cast("string"))
        .otherwise(F.expr(f"to_json({v})"))
    )
    return kind, value


def _opened(rows: DataFrame, key: str) -> DataFrame:
    """Each node once more, and after a container that was new its members or items, which are new in turn."""
    kept = ["path", "steps", "type", "value"]

    def child(step: Column, tail: Column, value: Column) -> Column:
        path, steps = F.concat("path", tail), F.concat("steps", F.array(step))
        return F.struct(path.alias("path"), steps.alias("steps"), F.lit(None).cast("string").alias("type"),
                        F.lit(None).cast("string").alias("value"), value.alias("v"))

    of_object = F.transform(F.map_entries("_members"), lambda e: child(_step(F.lit(None), e["key"]), _member_tail(e["key"]), e["value"]))
    of_array = F.transform("_items", lambda x, i: child(_step(i, F.lit(None)), _item_tail(i), x))
    kind, value = _kind_and_value("v", "_members", "_items")
    new = F.col("type").isNull()
    told = rows.withColumn("_members", F.when(new, _members("v"))).withColumn("_items", F.when(new, _items("v")))
    here = F.struct("path", "steps", F.when(new, kind).otherwise(F.col("type")).alias("type"),
                    F.when(new, value).otherwise(F.col("value")).alias("value"), F.expr("CAST(NULL AS VARIANT)").alias("v"))
    children = F.when(F.col("_members").isNotNull(), of_object).when(F.col("_items").isNotNull(), of_array)
    both = F.concat(F.array(here), F.coalesce(children, F.slice(F.array(here), 1, 0)))
    return told.select(key, F.inline(both)).select(key, *kept, "v")


def flatten_variant(documents: DataFrame, key: str, text: str) -> DataFrame:
    """As ``flatten_json``, without leaving the JVM: documents are parsed to variants and opened level by level.

    Passes of ``LEVELS_PER_PASS`` levels repeat, each written to the shared folder, until no new node is left, so
    there is no bound on depth and none on rows. Integers are exact to 38 digits. A variant does not keep the
    text of a number: whole numbers of 19 digits and more that were written with a point count as integers, and
    integers of 39 digits and more as doubles (``flatten_json`` tells them apart). A text with a repeated name
    in one object fails the query.
    """
    steps = F.array().cast("array<struct<index:int,member:string>>")
    none = F.lit(None).cast("string")
    rows = documents.where(F.col(text).isNotNull()).select(
        key, F.lit("$").alias("path"), steps.alias("steps"), none.alias("type"), none.alias("value"), F.parse_json(text).alias("v")
    )
    out = None
    while True:
        for _ in range(LEVELS_PER_PASS):
            rows = _opened(rows, key)
        written = materialize(rows, "nodes")
        done = written.where(F.col("type").isNotNull()).drop("v")
        out = done if out is None else out.unionByName(done)
        rows = written.where(F.col("type").isNull())
        if rows.isEmpty():
            return out


def result_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Every differing path of two long ``(keys, type, value)`` results; type-strict, no tolerance.

    Where both have ``steps``, the differences have them too.
    """
    on = list(keys)
    both = ["type", "value"] + (["steps"] if "steps" in expected.columns and "steps" in actual.columns else [])
    e = expected.select(*on, *[F.col(c).alias(f"expected_{c}") for c in both], F.lit(1).alias("_e"))
    a = actual.select(*on, *[F.col(c).alias(f"actual_{c}") for c in both], F.lit(1).alias("_a"))
    kind = (
        F.when(F.col("_a").isNull(), "missing")
        .when(F.col("_e").isNull(), "unexpected")
        .when(~F.col("expected_type").eqNullSafe(F.col("actual_type")), "type")
        .when(~F.col("expected_value").eqNullSafe(F.col("actual_value")), "value")
    )
    joined = e.join(a, on, "full_outer").withColumn("difference", kind)
    if "steps" in both:
        joined = joined.withColumn("steps", F.coalesce("expected_steps", "actual_steps")).drop("expected_steps", "actual_steps")
    return joined.filter(F.col("difference").isNotNull()).drop("_e", "_a")


FOUND = ("path", "steps", "difference", "expected_type", "actual_type", "expected_value", "actual_value")


def _same(e: str, a: str) -> Column:
    """Whether all below two nodes is surely the same. Numbers with a point may read as integers in the text of a
    variant, and the type of an array hides those of its items; such nodes are compared further down."""
    types = [F.expr(f"schema_of_variant({v})") for v in (e, a)]
    plain = (types[0] == types[1]) & ~types[0].rlike("DECIMAL|DOUBLE|VARIANT")
    return F.coalesce((F.expr(f"to_json({e})") == F.expr(f"to_json({a})")) & plain, F.lit(False))


def _compared(rows: DataFrame, key: str) -> DataFrame:
    """Differences found so far, those of the open pairs of nodes, and their open children that may differ."""
    new = F.col("difference").isNull()
    told = rows
    for v in ("e", "a"):
        told = told.withColumn(f"_m{v}", F.when(new, _members(v))).withColumn(f"_i{v}", F.when(new, _items(v)))
    (e_kind, e_value), (a_kind, a_value) = (_kind_and_value(v, f"_m{v}", f"_i{v}") for v in ("e", "a"))
    for side, v, kind, value in (("expected", "e", e_kind, e_value), ("actual", "a", a_kind, a_value)):
        there = new & F.col(v).isNotNull()
        told = told.withColumn(f"{side}_type", F.when(there, kind).otherwise(F.col(f"{side}_type")))
        told = told.withColumn(f"{side}_value", F.when(there, value).otherwise(F.col(f"{side}_value")))
    kind = (
        F.when(~new, F.col("difference")).when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected")
        .when(F.col("expected_type") != F.col("actual_type"), "type").when(F.col("expected_value") != F.col("actual_value"), "value")
    )
    none, text = F.expr("CAST(NULL AS VARIANT)"), F.lit(None).cast("string")

    def child(step: Column, tail: Column, e: Column, a: Column) -> Column:
        return F.struct(F.concat("path", tail).alias("path"), F.concat("steps", F.array(step)).alias("steps"),
                        *[text.alias(c) for c in FOUND[2:]], e.alias("e"), a.alias("a"))

    told = told.withColumn("_kind", kind)
    here = F.array(F.struct("path", "steps", F.col("_kind").alias("difference"), *FOUND[3:], none.alias("e"), none.alias("a")))
    nothing = F.slice(here, 1, 0)
    no_names = F.array().cast("array<string>")
    names = F.array_union(*[F.coalesce(F.map_keys(m), no_names) for m in ("_me", "_ma")])
    of_object = F.transform(names, lambda k: child(
        _step(F.lit(None), k), _member_tail(k), F.try_element_at(F.col("_me"), k), F.try_element_at(F.col("_ma"), k)))
    longest = F.greatest(F.lit(0), F.coalesce(F.size("_ie"), F.lit(0)), F.coalesce(F.size("_ia"), F.lit(0)))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    of_array = F.transform(places, lambda i: child(_step(i, F.lit(None)), _item_tail(i), F.get(F.col("_ie"), i), F.get(F.col("_ia"), i)))
    every = F.concat(F.when(F.col("_kind").isNotNull(), here).otherwise(nothing), of_object, of_array)
    opened = told.select(key, F.inline(every))
    return opened.where(F.col("difference").isNotNull() | ~_same("e", "a")).select(key, *FOUND, "e", "a")


def variant_diff(pairs: DataFrame, key: str, expected: str, actual: str) -> DataFrame:
    """``result_diff`` of the nodes of two JSON texts per row, with ``steps``, as ``flatten_variant`` tells them.

    Both texts are opened together, level by level; what is the same below a pair of nodes is left there and then,
    so that the work is that of the differing parts and no node is shuffled. A null text has no nodes.
    """
    text = F.lit(None).cast("string")
    differ = ~F.col(expected).eqNullSafe(F.col(actual))
    steps = F.array().cast("array<struct<index:int,member:string>>")
    rows = pairs.where(differ).select(
        key, F.lit("$").alias("path"), steps.alias("steps"), *[text.alias(c) for c in FOUND[2:]],
        F.parse_json(expected).alias("e"), F.parse_json(actual).alias("a"),
    )
    out = None
    while True:
        for _ in range(LEVELS_PER_PASS):
            rows = _compared(rows, key)
        written = materialize(rows, "differences")
        done = written.where(F.col("difference").isNotNull()).drop("e", "a")
        out = done if out is None else out.unionByName(done)
        rows = written.where(F.col("difference").isNull())
        if rows.isEmpty():
            return out


def first_difference(differences: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The difference that comes first in document order, one row per ``keys``; no row where none is."""
    rest = [c for c in differences.columns if c not in keys]
    ordered = F.struct("steps", *[c for c in rest if c != "steps"])
    first = differences.groupBy(*keys).agg(F.min(ordered).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return first.filter(F.col("_n") > 0).select(*keys, *[F.col(f"_first.{c}") for c in rest])
