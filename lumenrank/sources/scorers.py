"""Model scorers: request bodies, calls with retries, a limit in flight and a breaker, and the compact second try. The call itself is plugged in: there is no network and no model here."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenrank.functions import text
from lumenrank.functions.replies import KEYS, with_parsed
from lumenrank.functions.text import RATE_LIMIT, RETRYABLE
from lumenrank.sources.shared import materialise

Call = Callable[[dict], str]

# Fixed values.
CLAUDE_TOKENS = 300
#: What a reply must be: six whole scores, their total and a line.
SCHEMA = {
    "type": "object",
    "properties": {**{k: {"type": "integer", "minimum": 0, "maximum": 10} for k in KEYS}, "total": {"type": "integer", "minimum": 0, "maximum": 60}, "one_line": {"type": "string"}},
    "required": [*KEYS, "total", "one_line"],
    "additionalProperties": False,
}
PROMPT = "Rate this photo for a social media post. Context: {context}. Rate each criterion from 0 to 10: " + ", ".join(KEYS) + ". Return only a JSON object with these keys, total (their sum) and one_line (a short caption)."
COMPACT = "Context: {context}. Return only JSON with whole numbers 0-10 for " + ", ".join(KEYS) + ", total 0-60 and one_line."
BREAKER_OPEN = "circuit breaker open"


def claude_request(model: Column, payload: Column, prompt: Column, detected: Column | None = None) -> Column:
    """The JSON body of a request with one picture and one prompt; detected, if there is any, tells the model what a detector saw."""
    told = prompt if detected is None else F.concat(prompt, F.coalesce(F.concat(F.lit(" Detected: "), F.nullif(detected, F.lit(""))), F.lit("")))
    source = F.struct(F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), payload.alias("data"))
    image = F.to_json(F.struct(F.lit("image").alias("type"), source.alias("source")))
    words = F.to_json(F.struct(F.lit("text").alias("type"), told.alias("text")))
    return F.concat(F.lit('{"model":'), _quoted(model), F.lit(f',"max_tokens":{CLAUDE_TOKENS},"messages":[{{"role":"user","content":['), image, F.lit(","), words, F.lit("]}]}"))


def ollama_request(model: Column, payload: Column, account: Column, edge: Column, keep_alive: str = "10m", compact: bool = False) -> Column:
    """The JSON body of a chat request: models that think aloud (and second tries) get the compact prompt and the strict schema, all others the full prompt."""
    strict = text.is_qwen(model) | F.lit(compact)
    prompt = F.when(strict, text.prompt(COMPACT, account)).otherwise(text.prompt(PROMPT, account))
    form = F.when(strict, F.lit(json.dumps(SCHEMA))).otherwise(F.lit('"json"'))
    message = F.to_json(F.struct(F.lit("user").alias("role"), prompt.alias("content"), F.array(payload).alias("images")))
    options = F.concat(F.lit('{"temperature":0,"num_predict":'), text.token_budget(model, edge).cast("string"), F.lit("}"))
    return F.concat(F.lit('{"model":'), _quoted(model), F.lit(',"stream":false,"keep_alive":'), F.lit(json.dumps(keep_alive)), F.lit(',"format":'), form, F.lit(',"options":'), options, F.lit(',"messages":['), message, F.lit("]}"))


def _quoted(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'^\{"v":(.*)\}$', 1)


def with_retries(call: Call, item: dict, retries: int = 2, base: float = 0.75, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(reply, error): tried again, after waits that double, as long as the error may pass."""
    for attempt in range(retries + 1):
        try:
            return call(item), None
        except Exception as e:  # noqa: BLE001  whatever a client raises is an item's failure
            error = str(e)
            if attempt == retries or not any(m in error.lower() for m in RETRYABLE):
                return None, error
            sleep(base * 2**attempt)
    return None, None


class AdaptiveLimit:
    """How many calls may be in flight: one less after a rate limit, one more after every five calls."""

    def __init__(self, start: int = 3, least: int = 1, most: int = 8):
        self.now, self.least, self.most, self.calls = start, least, most, 0

    def done(self, rate_limited: bool, called: bool = True) -> int:
        self.calls += called
        if rate_limited:
            self.now = max(self.least, self.now - 1)
        elif self.calls % 5 == 0:
            self.now = min(self.most, self.now + 1)
        return self.now


class Client:
    """Calls of one task: so many in flight, and none more once limit calls in a row have failed."""

    def __init__(self, call: Call, concurrency: int = 2, retries: int = 2, base: float = 0.75, breaker: int = 6, adaptive: bool = False, sleep: Callable[[float], None] = time.sleep):
        self.call, self.retries, self.base, self.breaker, self.sleep = call, retries, base, breaker, sleep
        self.limit = AdaptiveLimit() if adaptive else None
        self.concurrency, self.failed_in_row, self.most_in_flight = concurrency, 0, 0

    def run(self, items: list[dict]) -> list[tuple[str | None, str | None]]:
        """(reply, error) of each item, in their order; items not sent because the breaker is open say so."""
        out: list[tuple[str | None, str | None]] = [(None, BREAKER_OPEN)] * len(items)
        flying: dict[Future, int] = {}
        todo = iter(enumerate(items))
        with ThreadPoolExecutor(max(self.concurrency, self.limit.most if self.limit else 1)) as pool:
            while True:
                while self.failed_in_row < self.breaker and len(flying) < (self.limit.now if self.limit else self.concurrency):
                    at = next(todo, None)
                    if at is None:
                        break
                    flying[pool.submit(with_retries, self.call, at[1], self.retries, self.base, self.sleep)] = at[0]
                    self.most_in_flight = max(self.most_in_flight, len(flying))
                if not flying:
                    return out
                for f in sorted(wait(flying, return_when=FIRST_COMPLETED).done, key=flying.__getitem__):
                    out[flying.pop(f)] = got = f.result()
                    self.failed_in_row = self.failed_in_row + 1 if got[1] else 0
                    if self.limit:
                        self.limit.done(bool(got[1]) and any(m in got[1].lower() for m in RATE_LIMIT))


def replies(items: DataFrame, make_call: Callable[[], Call], retries: int = 2, base: float = 0.75, concurrency: int = 2, breaker: int = 6, adaptive: bool = False) -> DataFrame:
    """items with reply and error. The client is made once a task and keeps concurrency calls in flight; after breaker failures in a row the task's other items are marked failed. Items already in a cache should be left out before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(make_call(), concurrency, retries, base, breaker, adaptive)
        for b in batches:
            got = client.run(b.to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*b.schema.names, "reply", "error"])

    return items.mapInArrow(run, StructType([*items.schema.fields, StructField("reply", StringType()), StructField("error", StringType())]))


ENVELOPE = "struct<message: struct<content: string, thinking: string>>"


def scored(items: DataFrame, make_call: Callable[[], Call], model: Column, account: Column, edge: Column, item: str = "path", keep_alive: str = "10m", **options) -> DataFrame:
    """(item, mode, error, vision) of items (item, payload): vision holds the scores of the model's reply, null where it failed.

    A reply that is no JSON is asked for once more with the compact prompt and the strict schema; the second answer
    counts, however it reads, unless the call fails. options are those of replies.
    """

    def asked(df: DataFrame, compact: bool) -> DataFrame:
        sent = df.withColumn("request", ollama_request(model, F.col("payload"), account, edge, keep_alive, compact)).select(item, "request")
        said = replies(sent, make_call, **options).withColumn("m", F.from_json("reply", ENVELOPE)["message"])
        said = said.select(item, "error", F.coalesce(F.col("m.content"), F.lit("")).alias("content"), F.coalesce(F.col("m.thinking"), F.lit("")).alias("thinking"))
        # written before it is read: the parser names its input often
        return materialise(with_parsed(materialise(said, "replies"), "content", "thinking").select(item, "mode", "error", F.col("payload").alias("vision")), "parsed")

    first = asked(items, False)
    again = first.where(F.col("mode").startswith("plain") | F.col("mode").startswith("neutral")).select(F.col(item).alias("__item"))
    second = asked(items.join(again, F.col(item) == F.col("__item"), "left_semi"), True).where("vision is not null")
    second = second.select(F.col(item).alias("__item"), F.col("mode").alias("__mode"), F.col("vision").alias("__vision"))
    both = first.join(second, F.col(item) == F.col("__item"), "left")
    return both.select(item, F.coalesce("__mode", "mode").alias("mode"), "error", F.coalesce("__vision", "vision").alias("vision"))


def replay(stored: dict[str, str]) -> Callable[[], Call]:
    """A scorer that answers from stored replies by item id and fails for others."""

    def make() -> Call:
        def call(item: dict) -> str:
            if item["item_id"] not in stored:
                raise RuntimeError("no stored reply")
            return stored[item["item_id"]]

        return call

    return make


def first_working(candidates: list[str], ping: Callable[[str], None]) -> str:
    """The first model that answers; only an unknown model leads on to the next."""
    for name in candidates:
        try:
            ping(name)
            return name
        except Exception as e:  # noqa: BLE001
            low = str(e).lower()
            if not ("not_found_error" in low and "model" in low):
                raise
    raise RuntimeError("no candidate model is known")
