"""Chat formatting: tool calls linked to their results, in topological order, checked and serialised; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import saved


_FORMS = {"integer": r"^-?(0|[1-9][0-9]*)$", "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}


def _json(text: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1)


@dataclass(frozen=True)
class Argument:
    """kind: string, integer, number or boolean; bounds hold for numbers, lengths for strings (in characters)."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None

    def fits(self, value: Column) -> Column:
        """Is the text a JSON value of this kind? Numbers that no double holds don't fit."""
        if self.kind == "string":
            return F.lit(True)
        fits = value.rlike(_FORMS[self.kind])
        return fits & (F.abs(value.try_cast("double")) < float("inf")) if self.kind == "number" else fits

    def json(self, value: Column) -> Column:
        """One form for each value: strings quoted, integers without a negative zero, numbers as Spark writes a double, without a
        fraction where there is none (below 10^15). What doesn't fit is quoted."""
        if self.kind == "integer":
            bare = F.when(value == "-0", "0").otherwise(value)
        elif self.kind == "number":
            d = value.try_cast("double")
            bare = F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.try_cast("long").cast("string")).otherwise(d.cast("string"))
        else:
            bare = value
        return _json(value) if self.kind == "string" else F.when(self.fits(value), bare).otherwise(_json(value))

    def problem(self, arguments: Column) -> Column:
        """What is wrong with the argument in the map ``arguments`` (texts of JSON values), or null."""
        value = F.try_element_at(arguments, F.lit(self.name))
        size = F.char_length(value).cast("double") if self.kind == "string" else value.try_cast("double")
        low = size < self.least if self.least is not None else F.lit(False)
        high = size > self.most if self.most is not None else F.lit(False)
        missing = F.lit(f"{self.name}: missing") if self.required else F.lit(None).cast("string")
        return (
            F.when(value.isNull(), missing).when(~self.fits(value), F.lit(f"{self.name}: not of type {self.kind}")).when(F.coalesce(low, F.lit(False)), F.lit(f"{self.name}: too small")).when(F.coalesce(high, F.lit(False)), F.lit(f"{self.name}: too large"))
        )


def problems(arguments: Column, schema: tuple[Argument, ...]) -> Column:
    """What is wrong with the arguments, in the schema's order, then those it doesn't name, by name."""
    own = F.array_compact(F.array(*[a.problem(arguments) for a in schema]))
    more = F.array_sort(F.array_except(F.map_keys(arguments), F.array(*[F.lit(a.name) for a in schema])))
    return F.concat(own, F.coalesce(F.transform(more, lambda x: F.concat(x, F.lit(": not in the schema"))), F.array().cast("array<string>")))


def canonical(arguments: Column, schema: tuple[Argument, ...]) -> Column:
    """JSON of all arguments: keys in the order of their code points, no blanks; values by the schema (see ``Argument.json``), others quoted."""

    def pair(e: Column) -> Column:
        value = _json(e["value"])
        for a in schema:
            value = F.when(e["key"] == a.name, a.json(e["value"])).otherwise(value)
        return F.concat(_json(e["key"]), F.lit(":"), value)

    return F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(arguments)), pair), ","), F.lit("")), F.lit("}"))


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level``: 0 for calls that depend on no call that exists, else one more than the highest they depend on; null on a cycle.

    ``calls``: ``call_id, depends_on`` (one row for each dependency, null for none). Each round settles the calls whose
    dependencies are settled, so there are as many rounds as levels; rounds are joins by id.
    """
    edges = calls.where("depends_on IS NOT NULL").select("call_id", F.col("depends_on").alias("to")).distinct()
    nodes = calls.select("call_id").where("call_id IS NOT NULL").distinct()
    edges = saved(edges.join(nodes.withColumnRenamed("call_id", "to"), "to"), "edges")
    done = saved(nodes.join(edges, "call_id", "left_anti").withColumn("level", F.lit(0)), "levels")
    left, k = edges, 0
    while True:
        # Calls all of whose open dependencies were settled in the round before.
        left = saved(left.join(done.where(F.col("level") == k).select(F.col("call_id").alias("to")), "to", "left_anti"), "edges")
        k += 1
        settled = edges.select("call_id").distinct().join(left.select("call_id").distinct(), "call_id", "left_anti").join(done.select("call_id"), "call_id", "left_anti")
        settled = saved(settled.withColumn("level", F.lit(k)), "levels")
        if settled.isEmpty():
            break
        done = done.unionByName(settled)
    return nodes.join(done, "call_id", "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, tuple[Argument, ...]]) -> DataFrame:
    """One row for each call and one for each result that no call's row has.

    ``calls``: ``conv_id, turn, call_id, name, arguments`` (map of texts), ``depends_on`` (a call_id or null); ``results``:
    ``conv_id, turn, call_id, content``. Returns ``conv_id, turn, call_id, name, level, status, problems, json``: level gives the
    topological order (then turn, then call_id); status is answered, unanswered, duplicate (a call whose id an earlier turn
    has), orphan (a result without a call) or extra (a further result of a call); problems lists what the schema of the call's name says
    against its arguments, those it doesn't name included, ``unknown tool`` for a name without one; json is the canonical form of the call
    with its result, all arguments included.

    Of calls or results with one id the first counts (least turn, then text); a call or result repeated in full counts once. Null call_id: the call is
    unanswered and on level 0; a result with null call_id is an orphan. Null arguments: none; an argument that is null counts as missing.
    Null name: unknown tool. Other columns are ignored. Empty tables give an empty result.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", F.to_json(F.map_filter("arguments", lambda _, v: v.isNotNull())).alias("args"), "depends_on").distinct()
    calls = saved(calls, "calls")
    results = results.select("conv_id", "turn", "call_id", "content").distinct()
    first = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "conv_id", "name", "args", "depends_on")).alias("first"))
    answer = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content", "conv_id")).alias("answer"))
    order = levels(calls.select("call_id", "depends_on"))
    linked = calls.join(first, "call_id", "left").join(answer, "call_id", "left").join(order, "call_id", "left")
    same = F.struct("turn", "conv_id", "name", "args", "depends_on").eqNullSafe(F.col("first"))
    status = F.when(F.col("call_id").isNotNull() & ~same, "duplicate").when(F.col("answer").isNull(), "unanswered").otherwise("answered")
    linked = linked.withColumn("status", status).withColumn("arguments", F.from_json("args", "map<string,string>"))
    found, body = F.array(F.lit("unknown tool")), canonical(F.col("arguments"), ())
    for name, schema in schemas.items():
        here = F.col("name") == name
        found = F.when(here, problems(F.col("arguments"), schema)).otherwise(found)
        body = F.when(here, canonical(F.col("arguments"), schema)).otherwise(body)
    fields = [
        F.concat(F.lit('"arguments":'), body),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"id":'), _json(F.col("call_id")))),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), _json(F.col("name")))),
        F.when((F.col("status") == "answered") & F.col("answer.content").isNotNull(), F.concat(F.lit('"result":'), _json(F.col("answer.content")))),
    ]
    linked = linked.select(
        "conv_id", "turn", "call_id", "name", F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level")).alias("level"), "status", F.array_join(found, "; ").alias("problems"), F.concat(F.lit("{"), F.array_join(F.array(*fields), ","), F.lit("}")).alias("json")
    )
    met = results.join(first.select("call_id", F.lit(True).alias("called")), "call_id", "left").join(answer, "call_id", "left")
    shown = F.struct("turn", "content", "conv_id").eqNullSafe(F.col("answer"))
    stray = met.where(F.col("called").isNull() | ~shown)
    form = F.array_join(F.array(F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"id":'), _json(F.col("call_id")))), F.when(F.col("content").isNotNull(), F.concat(F.lit('"result":'), _json(F.col("content"))))), ",")
    stray = stray.select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"), F.when(F.col("called"), "extra").otherwise("orphan").alias("status"), F.lit("").alias("problems"), F.concat(F.lit("{"), form, F.lit("}")).alias("json")
    )
    return linked.unionByName(stray)
