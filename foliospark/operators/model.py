"""The model-call operator: keyed requests, cache, replay, mock and HTTP clients, admission, ledger."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from foliospark.functions.keys import request_key
from foliospark.functions.tokens import count_tokens, estimate_tokens
from foliospark.operators.rank import global_rank
from foliospark.session import cut

#: Published context windows, output limits and USD for a million tokens (in, out, cached in).
MODELS = [
    ("gpt-4o-mini", "chat", 128000, 16384, 0.15, 0.60, 0.075), ("gpt-4o", "chat", 128000, 16384, 2.50, 10.00, 1.25),
    ("gpt-4.1", "chat", 1047576, 32768, 2.00, 8.00, 0.50), ("gpt-4.1-mini", "chat", 1047576, 32768, 0.40, 1.60, 0.10),
    ("text-embedding-3-small", "embedding", 8191, 0, 0.02, None, None), ("mock", "chat", 32000, 4096, 0.0, 0.0, 0.0),
]
MODEL_SCHEMA = "id string, kind string, context_window int, max_output int, input_usd double, output_usd double, cached_input_usd double"
REPLY = "key string, reply string, ok boolean, error string, finish_reason string, tokens_in int, tokens_out int, seconds double"
#: HTTP statuses worth another try, tokens a message and a request add.
RETRY_STATUS = {408, 409, 425, 429, 500, 502, 503, 504}
PER_MESSAGE, PER_REQUEST = 4, 3


def models(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """The model dimension; a later row of the same id wins. A few dozen rows, so joins broadcast it."""
    table = {m[0]: m for m in [*MODELS, *extra]}
    return spark.createDataFrame(list(table.values()), MODEL_SCHEMA)


def price(tokens_in: Column, tokens_out: Column, cached_in: Column) -> Column:
    """USD of one call, over model columns; null where a price that is needed is unknown."""
    cached = F.coalesce(F.col("cached_input_usd"), F.col("input_usd"))
    out = F.when((tokens_out > 0) & (F.col("kind") != "embedding"), tokens_out / 1e6 * F.col("output_usd")).otherwise(0.0)
    return (tokens_in - cached_in) / 1e6 * F.col("input_usd") + F.when(cached_in > 0, cached_in / 1e6 * cached).otherwise(0.0) + out


def budget(margin: float = 0.1, reserve: int = 1500, overhead: int = 0) -> dict[str, Column]:
    """Columns over the model dimension: usable window, and what is left for input."""
    usable = F.floor(F.col("context_window") * (1 - margin)).cast("bigint")
    return {"usable": usable, "input_room": F.greatest(usable - reserve - overhead, F.lit(0))}


# ---------------------------------------------------------------- clients
@dataclass(frozen=True)
class Client:
    """``make()`` runs once a partition and returns send(prompt, params) -> (reply, finish_reason)."""

    name: str
    make: Callable[[], Callable[[str, dict], tuple[str, str]]]


def mock_client(answer: Callable[[str], str], name: str = "mock") -> Client:
    """A deterministic stand-in: the reply is a function of the prompt."""
    return Client(name, lambda: lambda prompt, params: (answer(prompt), "stop"))


def backoff(attempt: int, retry_after: float | None = None, base: float = 1.0, most: float = 60.0, rng=random.random) -> float:
    """Seconds before a retry: the server's wish, or doubling with jitter."""
    return min(retry_after, most) if retry_after is not None else min(most, base * 2**attempt) * (0.5 + rng() / 2)


#: Efforts that chat completions take.
EFFORTS = ("minimal", "low", "medium", "high")


def checked_headers(headers: dict[str, str] | None) -> dict[str, str]:
    """Header names and values that a request can carry; anything else is an error, before a request is made."""
    out = {}
    for name, value in (headers or {}).items():
        if not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) or re.search(r"[\r\n\0]", str(value)):
            raise ValueError(f"{name!r} cannot be a header")
        out[name] = str(value)
    return out


def api_key(variable: str) -> str:
    """The key that an environment variable of this machine holds."""
    import os

    if not os.environ.get(variable, "").strip():
        raise KeyError(f"no key: set {variable}")
    return os.environ[variable].strip()


def http_client(
    url: str, key_variable: str, model: str, tries: int = 5, timeout: float = 120.0, headers: dict[str, str] | None = None, effort: str | None = None,
) -> Client:
    """Chat completions over HTTP; the key is read from an environment variable on the executor, never shipped. What the
    model is told before a prompt's kind goes as the system's message."""
    extra = checked_headers(headers)
    if effort is not None and effort not in EFFORTS:
        raise ValueError(f"an effort is one of {', '.join(EFFORTS)}")

    def make():
        import urllib.error
        import urllib.request

        from foliospark.plans.prompts import system_prompt

        key = api_key(key_variable)

        def send(prompt: str, params: dict) -> tuple[str, str]:
            told = system_prompt(prompt)
            messages = [*([{"role": "system", "content": told}] if told else []), {"role": "user", "content": prompt}]
            asked = {"model": model, "messages": messages, **({"reasoning_effort": effort} if effort else {}), **params}
            body = json.dumps(asked).encode()
            for attempt in range(tries):
                request = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}", **extra})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as response:
                        choice = json.load(response)["choices"][0]
                        return choice["message"]["content"], choice.get("finish_reason", "stop")
                except urllib.error.HTTPError as e:
                    quota = b"insufficient_quota" in e.read()
                    if e.code not in RETRY_STATUS or quota or attempt == tries - 1:
                        raise
                    after = e.headers.get("Retry-After")
                    time.sleep(backoff(attempt, float(after) if after and after.replace(".", "").isdigit() else None))
            raise RuntimeError("no try left")

        return send

    return Client(f"http:{model}" + (f":{effort}" if effort else ""), make)


# ---------------------------------------------------------------- calls
def keyed(requests: DataFrame, client: str) -> DataFrame:
    """Add ``key`` over client, model, prompt, parameters and draw; absent ones count as null."""
    have = set(requests.columns)
    parts = [F.col(c) if c in have else F.lit(None) for c in ("model", "prompt", "params", "schema", "draw")]
    return requests.withColumn("key", request_key(F.lit(client), *parts))


REPLY_COLUMNS = [c.split()[0] for c in REPLY.split(", ")]


def call(requests: DataFrame, client: Client | Desk, cache: DataFrame | None = None, concurrency: int | None = None) -> DataFrame:
    """requests(…, prompt[, model, params, draw]) with their replies and ``cached``.

    Equal requests are sent once. What the cache knows is not sent; the cache is looked up once and what it knew is
    written, so a cache that is itself a plan of calls does not run again. A failed call is a row with ok = false and
    an error, never a failed task; a task that Spark runs again sends the same keys, so a keyed cache stays right. A
    Desk brings a cache, limits and a ledger of its own.
    """
    if isinstance(client, Desk):
        return _call_at(requests, client, concurrency)
    named = keyed(requests, client.name)
    todo, known = _distinct(named), None
    if cache is not None:
        todo, known = _looked_up(todo, cache)
    answered = _send(todo, client, concurrency).withColumn("cached", F.lit(False))
    if known is not None:
        answered = answered.unionByName(known.withColumn("cached", F.lit(True)))
    return named.join(answered, "key", "left")


def _distinct(named: DataFrame) -> DataFrame:
    params = F.col("params") if "params" in named.columns else F.lit(None).cast("string")
    return named.select("key", "prompt", params.alias("params")).dropDuplicates(["key"])


def _looked_up(todo: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests to send, replies that are known), from one look at the cache."""
    columns = dict(c.split() for c in REPLY.split(", ")[1:])
    have = [(F.col(c) if c in cache.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()]
    one = cache.groupBy("key").agg(F.min_by(F.struct(*have), F.col("reply")).alias("_known"))
    looked = cut(todo.join(one, "key", "left"))
    return looked.filter("_known is null").drop("_known"), looked.filter("_known is not null").select("key", "_known.*")


def _send(todo: DataFrame, client: Client, concurrency: int | None = None) -> DataFrame:
    """REPLY columns of todo(key, prompt, params)."""
    if concurrency:
        todo = todo.repartition(concurrency, "key")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client.make()
        for pdf in parts:
            rows = []
            for key, prompt, params in zip(pdf.key, pdf.prompt, pdf.params, strict=True):
                began = time.perf_counter()
                try:
                    reply, reason = send(prompt or "", json.loads(params) if params else {})
                    rows.append((key, reply, True, None, reason, estimate_tokens(prompt), estimate_tokens(reply), time.perf_counter() - began))
                except Exception as e:  # the contract: errors are values of the row
                    rows.append((key, None, False, f"{type(e).__name__}: {e}"[:500], "error", estimate_tokens(prompt), 0, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=REPLY_COLUMNS)

    return todo.select("key", "prompt", "params").mapInPandas(run, REPLY)


def call_in_turn(rows: DataFrame, client: Client, by: str, order: str, take: Callable, schema: str) -> DataFrame:
    """A row each group of ``rows``, folded in ``order`` where each request needs the reply before it: ``take(state, row,
    ask)`` gives the next state, at first of None. A state is a tuple of the schema's columns behind ``by``.

    ask(prompt) -> (reply, ok); as in ``call``, a failed request is a value. A group's rows stream through one task, so
    none is held whole, and the plan does not grow with the longest group. A Desk, whose limits span all groups, is not
    for it.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client.make()

        def ask(prompt: str | None) -> tuple[str | None, bool]:
            try:
                return send(prompt or "", {})[0], True
            except Exception:  # the contract: errors are values
                return None, False

        group = state = None
        for pdf in parts:
            done = []
            for row in pdf.itertuples(index=False):
                if state is not None and getattr(row, by) != group:
                    done.append((group, *state))
                    state = None
                group = getattr(row, by)
                state = take(state, row, ask)
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(group, *state)], columns=names)

    return rows.repartition(by).sortWithinPartitions(by, order).mapInPandas(run, schema)


def cacheable(replies: DataFrame) -> DataFrame:
    """What a cache may keep: good, complete, not from the cache already; a row a key."""
    keep = replies.filter(F.col("ok") & (F.col("finish_reason") != "length") & ~F.col("cached"))
    return keep.select(*REPLY_COLUMNS).dropDuplicates(["key"])


def write_cache(replies: DataFrame, path: str) -> None:
    """Append to a cache; a key that is written twice is harmless, since a look-up takes one row a key."""
    cacheable(replies).write.mode("append").parquet(path)


def replay(requests: DataFrame, recorded: DataFrame, client: str, order: str) -> DataFrame:
    """Recorded replies in the order they were recorded: the n-th request of a key gets its n-th reply.

    recorded(key, step, reply). ``missed`` marks requests that no recording is left for.
    """
    named = keyed(requests, client)
    asked = named.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    told = recorded.select("key", "reply", F.row_number().over(Window.partitionBy("key").orderBy("step")).alias("turn"))
    return asked.join(told, ["key", "turn"], "left").withColumn("missed", F.col("reply").isNull())


def read_json(reply: Column, schema: str) -> Column:
    """A JSON reply as a struct, out of a code fence or surrounding prose; null if it does not parse."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\}|\[.*\])", 1), schema, {"mode": "PERMISSIVE"})


_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def schema_problem(value, schema: dict, at: str = "reply") -> str | None:
    """The first thing about a JSON value that its schema (type, enum, required, properties, items,
    additionalProperties) does not allow; None if it fits."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = any(isinstance(value, _KINDS[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or (k == "integer" and isinstance(value, float) and value == int(value)) for k in kinds)
        if not fits:
            return f"{at} is no {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at} is none of {', '.join(map(str, schema['enum']))}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at} lacks {name}"
        for name, inner in value.items():
            if name in known:
                if problem := schema_problem(inner, known[name], f"{at}.{name}"):
                    return problem
            elif schema.get("additionalProperties") is False:
                return f"{at} has {name}, which the schema does not"
    if isinstance(value, list) and "items" in schema:
        for k, inner in enumerate(value):
            if problem := schema_problem(inner, schema["items"], f"{at}[{k}]"):
                return problem
    return None


def reply_problem(reply: str | None, schema: dict) -> str | None:
    """Why a reply is no JSON value of the schema; a code fence or prose around it is put up with."""
    m = re.search(r"(?s)(\{.*\}|\[.*\])", reply or "")
    try:
        return schema_problem(json.loads(m[1] if m else reply or ""), schema)
    except json.JSONDecodeError as e:
        return f"reply is no JSON: {e.msg}"


def call_json(requests: DataFrame, client: Client | Desk, schema: dict, tries: int = 2) -> DataFrame:
    """``call`` for replies that are JSON of a schema: adds ``problem``, null where the reply fits.

    A reply that does not fit is asked for again, with what was wrong, ``tries`` times in all; the last one stands.
    """

    @F.pandas_udf("string")
    def check(replies: pd.Series) -> pd.Series:
        return replies.map(lambda r: reply_problem(r, schema))

    columns = requests.columns
    work, done = requests.withColumn("_asked", F.col("prompt")), None
    for n in range(tries):
        told = cut(call(work, client).withColumn("problem", F.when(F.col("ok"), check("reply"))))
        last = n == tries - 1
        good = told if last else told.filter(F.col("problem").isNull())
        done = good if done is None else done.unionByName(good)
        if last or told.filter("problem is not null").isEmpty():
            break
        again = F.concat("_asked", F.lit("\n\nThe last reply could not be used: "), "problem", F.lit("."))
        work = told.filter("problem is not null").select(*columns, "_asked", again.alias("_again")).withColumn("prompt", F.col("_again")).drop("_again")
    return done.withColumn("prompt", F.col("_asked")).drop("_asked")


# ---------------------------------------------------------------- admission and ledger
@dataclass(frozen=True)
class Governor:
    """Limits of a run; None is no limit."""

    max_calls: int | None = 400
    max_cost_usd: float | None = 5.0
    max_tokens_total: int | None = None
    max_output_tokens: int | None = None
    allowed_models: tuple[str, ...] | None = None
    allow_unpriced: bool = False
    margin: float = field(default=0.1)


LEDGER = (
    "turn int, label string, model string, key string, prompt string, reply string, ok boolean, cached boolean, refused string, error string, finish_reason string,"
    " tokens_in int, tokens_out int, tokens_cached_in int, provenance string, usd double, seconds double"
)


@dataclass
class Desk:
    """A client with what a run adds to it, taken wherever a client is: a cache, limits, a ledger.

    ``folder`` is shared storage. cache/ holds good, complete replies by key; a later run that names the same folder
    sends nothing again. ledger/ gets a row for each request that was looked up, sent or refused. ``governor`` limits
    what is sent over the desk's life; a refused request is a row with ok = false. ``spent`` is the running account.
    """

    client: Client
    folder: str
    governor: Governor | None = None
    model: str = "mock"
    max_output: int = 1000
    label: str = "call"
    prices: tuple[tuple, ...] = tuple(MODELS)
    turn: int = 0
    spent: dict = field(default_factory=lambda: {"calls": 0, "tokens": 0, "usd": 0.0})

    @property
    def name(self) -> str:
        return self.client.name

    def make(self):
        return self.client.make()

    def cache(self, spark: SparkSession) -> DataFrame | None:
        return _read_if_there(spark, f"{self.folder}/cache")

    def ledger(self, spark: SparkSession) -> DataFrame:
        """Rows of all turns with ``step``, their order: by turn, then key."""
        found = _read_if_there(spark, f"{self.folder}/ledger")
        found = spark.createDataFrame([], LEDGER) if found is None else found
        return global_rank(found, "step", "turn", "key").withColumn("step", F.col("step").cast("int"))

    def left(self) -> Governor | None:
        """The limits less what is spent."""
        g, s = self.governor, self.spent
        if g is None:
            return None
        less = lambda most, used: None if most is None else max(most - used, 0)
        return replace(g, max_calls=less(g.max_calls, s["calls"]), max_cost_usd=less(g.max_cost_usd, s["usd"]), max_tokens_total=less(g.max_tokens_total, s["tokens"]))


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def _call_at(requests: DataFrame, desk: Desk, concurrency: int | None) -> DataFrame:
    """The turn of a desk: look up, admit, send, store, enter in the ledger."""
    spark = requests.sparkSession
    named = keyed(requests if "model" in requests.columns else requests.withColumn("model", F.lit(desk.model)), desk.name)
    todo, cache = _distinct(named), desk.cache(spark)
    none = spark.createDataFrame([], REPLY)
    todo, known = _looked_up(todo, none if cache is None else cache)
    row = {m[0]: m for m in desk.prices}.get(desk.model)
    usd_in, usd_out = (row[4], row[5]) if row else (None, None)
    limits = desk.left()
    margin = 1 + (limits.margin if limits else 0.0)
    size = F.ceil((count_tokens(F.col("prompt")) + PER_MESSAGE + PER_REQUEST) * margin).cast("int")
    worst = F.lit(None).cast("double") if usd_in is None else F.col("tokens_in") / 1e6 * usd_in + (desk.max_output / 1e6 * usd_out if usd_out is not None else 0.0)
    sized = todo.withColumns({"model": F.lit(desk.model), "tokens_in": size, "max_output": F.lit(desk.max_output)}).withColumn("worst_usd", worst)
    if limits is None:
        judged = sized.withColumn("refused", F.lit(None).cast("string"))
    else:
        judged = admit(global_rank(sized, "_n", "key"), limits, "_n").drop("_n")
    judged = cut(judged.select("key", "prompt", "params", "refused"))
    sent = cut(_send(judged.filter("refused is null"), desk.client, concurrency).withColumn("cached", F.lit(False)))
    refused = judged.filter("refused is not null").select(
        "key", F.lit(None).cast("string").alias("reply"), F.lit(False).alias("ok"), F.concat(F.lit("refused: "), "refused").alias("error"), F.lit("refused").alias("finish_reason"),
        F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"), F.lit(0.0).alias("seconds"), F.lit(False).alias("cached"),
    )
    answered = sent.unionByName(refused).unionByName(known.withColumn("cached", F.lit(True)))
    write_cache(sent, f"{desk.folder}/cache")
    paid = lambda c: F.when(F.col("cached") | F.col("error").startswith("refused"), 0.0).otherwise(c)
    cost = F.lit(None).cast("double") if usd_in is None else F.col("tokens_in") / 1e6 * usd_in + F.col("tokens_out") / 1e6 * (usd_out or 0.0)
    told = answered.join(_distinct(named).select("key", "prompt"), "key").join(judged.select("key", "refused"), "key", "left").withColumn("usd", F.coalesce(paid(cost), cost))
    told = told.withColumns({"turn": F.lit(desk.turn), "label": F.lit(desk.label), "model": F.lit(desk.model), "tokens_cached_in": F.lit(0), "provenance": F.lit("estimated")})
    told.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in LEDGER.split(", ")]).write.mode("append").parquet(f"{desk.folder}/ledger")
    sums = sent.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("usd")).first()  # one row
    desk.turn += 1
    for k in desk.spent:
        desk.spent[k] += sums[k]
    return named.join(answered, "key", "left")


def trace_save(ledger: DataFrame, path: str) -> None:
    """Write a ledger for replay, as JSON lines where the path says .json, else as Parquet; nothing is overwritten."""
    (ledger.write.json if path.endswith((".json", ".jsonl")) else ledger.write.parquet)(path)


def trace_load(spark: SparkSession, path: str) -> DataFrame:
    """A saved ledger; its (key, step, reply) is what ``replay`` takes."""
    return spark.read.schema(f"{LEDGER}, step int").json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def admit(requests: DataFrame, governor: Governor, order: str) -> DataFrame:
    """Add ``refused``: the first check a request fails, null if it may be sent.

    requests(model, tokens_in, max_output, worst_usd). Checks: model, output, calls, tokens, price, cost. Limits on
    sums take requests in ``order`` and charge each admitted request its worst case. The running sums
    are taken in two steps, inside ranges of a numeric ``order`` and over the ranges' totals, so no task sees all
    requests; another kind of order takes one window.
    """
    g = governor
    first = F.when(~F.col("model").isin(*g.allowed_models), "model") if g.allowed_models is not None else F.lit(None).cast("string")
    if g.max_output_tokens is not None:
        first = F.coalesce(first, F.when(F.col("max_output") > g.max_output_tokens, "output"))
    priced = F.lit(None).cast("string") if g.allow_unpriced else F.when(F.col("worst_usd").isNull(), "price")
    ok = requests.withColumn("_own", first).withColumn("_price", priced)
    open_ = F.col("_own").isNull() & F.col("_price").isNull()
    charge = lambda c: F.when(open_, c).otherwise(0)
    ok = ok.withColumns({"_calls": charge(F.lit(1)), "_tokens": charge(F.col("tokens_in") + F.col("max_output")), "_usd": charge(F.coalesce("worst_usd", F.lit(0.0)))})
    sums = ["_calls", "_tokens", "_usd"]
    if isinstance(ok.schema[order].dataType, NumericType):
        ok = ok.withColumn("_range", F.floor(F.col(order) / 4096))
        totals = ok.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums])
        ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in sums])
        w = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ok = ok.withColumns({c: F.sum(c).over(w) for c in sums}).join(before, F.col("_range").eqNullSafe(F.col("_of")))
        ok = ok.withColumns({c: F.coalesce(F.col(c), F.lit(0)) + F.col(f"{c}_before") for c in sums}).drop("_range", "_of", *[f"{c}_before" for c in sums])
    else:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        ok = ok.withColumns({c: F.sum(c).over(w) for c in sums})
    over = F.lit(None).cast("string")
    if g.max_calls is not None:
        over = F.coalesce(over, F.when(F.col("_calls") > g.max_calls, "calls"))
    if g.max_tokens_total is not None:
        over = F.coalesce(over, F.when(F.col("_tokens") > g.max_tokens_total, "tokens"))
    cost = F.when(F.col("_usd") > g.max_cost_usd + 1e-9, "cost") if g.max_cost_usd is not None else F.lit(None).cast("string")
    return ok.withColumn("refused", F.coalesce("_own", F.when(open_, over), "_price", F.when(open_, cost))).drop("_own", "_price", "_calls", "_tokens", "_usd")


def usd12(c: Column) -> Column:
    """Money to twelve decimal places."""
    return F.round(c, 12)


def trace_cost(ledger: DataFrame, dimension: DataFrame) -> DataFrame:
    """Per model: calls, paid calls (not cached), tokens, cost. A model without a price has a null cost.

    ledger(model, cached, tokens_in, tokens_out, tokens_cached_in). Summed before the join, so the join sees one row
    a model.
    """
    paid = ~F.coalesce(F.col("cached"), F.lit(False))
    s = lambda c: F.sum(F.when(paid, F.coalesce(F.col(c), F.lit(0))).otherwise(0)).cast("bigint")
    sums = ledger.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(paid.cast("int")).cast("bigint").alias("paid_calls"), s("tokens_in").alias("paid_in"), s("tokens_out").alias("paid_out"), s("tokens_cached_in").alias("cached_in"),
    )
    joined = sums.join(dimension.withColumnRenamed("id", "model"), "model", "left")
    usd = price(F.col("paid_in"), F.col("paid_out"), F.col("cached_in"))
    free = (F.col("paid_in") == 0) & (F.col("paid_out") == 0)
    return joined.select("model", "calls", "paid_calls", "paid_in", "paid_out", "cached_in", usd12(F.when(free, 0.0).otherwise(usd)).alias("usd"))


def trace_summary(ledger: DataFrame) -> DataFrame:
    """One row: calls, cached, failed, tokens in and out, the share of calls whose usage is an estimate."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return ledger.agg(
        F.count(F.lit(1)).alias("calls"), n(F.col("cached")).alias("cached"), n(~F.col("ok")).alias("failed"),
        F.sum("tokens_in").cast("bigint").alias("tokens_in"), F.sum("tokens_out").cast("bigint").alias("tokens_out"), F.round(F.avg(F.when(F.col("provenance") == "estimated", 1.0).otherwise(0.0)), 6).alias("estimated_share"),
    )


def absorb(ledger: DataFrame, other: DataFrame, *by: str) -> DataFrame:
    """Two ledgers as one, the other's steps behind the first's, renumbered."""
    both = ledger.withColumn("_src", F.lit(0)).unionByName(other.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy("_src", "step"))).drop("_src")


def as_json(df: DataFrame) -> DataFrame:
    """One canonical JSON object a row: fields in schema order, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
