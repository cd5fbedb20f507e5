"""The provider interface and the operator that calls it, once for each distinct request, with a written result.

Request: (key, phase, system, prompt, options). Reply: (text, prompt_tokens, completion_tokens, latency_s, failed).
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import STOP_WORDS
from factloom.session import cut

REPLY = "request_key binary, text string, prompt_tokens long, completion_tokens long, latency_s double, failed boolean"


@dataclass(frozen=True)
class Request:
    phase: str
    system: str
    prompt: str
    statement: str = ""
    context: str = ""


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    latency_s: float = 0.0
    failed: bool = False


class Provider(Protocol):
    """Made once per partition, and only if the partition has requests."""

    name: str
    on_failure: str

    def open(self) -> Callable[[Request], Reply]: ...


@dataclass(frozen=True)
class LexicalProvider:
    """A deterministic stand-in for tests: word coverage instead of judgement. Not a substitute for a model.

    verify: YES above `yes`, NO below `no`, else NOT SURE; a negated statement is turned round. decompose: sentences.
    synonyms and antonyms: fixed wrappers. judge: True above `yes`. inject: a fixed prefix.
    """

    yes: float = 0.75
    no: float = 0.4
    name: str = "lexical"
    on_failure: str = ""

    def open(self) -> Callable[[Request], Reply]:
        stop = frozenset(STOP_WORDS)

        @lru_cache(256)  # requests on one passage come in a row
        def core(text: str) -> frozenset[str]:
            return frozenset(re.findall(r"[^\W_]{2,}", text.lower())) - stop

        def answer(r: Request) -> str:
            if r.phase == "decompose":
                return json.dumps([s for s in re.split(r"(?<=[.!?])\s+", r.statement.strip()) if s])
            if r.phase == "synonyms":
                return f"It is true that {r.statement}\nPut differently: {r.statement}"
            if r.phase == "antonyms":
                return f"It is false that {r.statement}\nNobody holds that {r.statement}"
            if r.phase == "inject":
                return f"Not so: {r.statement}"
            negated = r.statement.startswith(("It is false that", "Nobody holds that"))
            said = core(re.sub(r"^(It is (true|false) that|Put differently:|Nobody holds that)", "", r.statement))
            share = len(said & core(r.context)) / len(said) if said else 0.0
            if r.phase == "judge":
                return str(share > self.yes)
            verdict = "YES" if share > self.yes else "NO" if share < self.no else "NOT SURE"
            return {"YES": "NO", "NO": "YES"}.get(verdict, verdict) if negated else verdict

        def call(r: Request) -> Reply:
            text = answer(r)
            return Reply(text, len(r.prompt.split()), len(text.split()))

        return call


@dataclass(frozen=True)
class ReplayProvider:
    """Replies from a mapping of prompts (small, for tests); see replay() for a table of any size."""

    replies: dict[str, str] = field(default_factory=dict)
    name: str = "replay"
    on_failure: str = ""

    def open(self) -> Callable[[Request], Reply]:
        def call(r: Request) -> Reply:
            text = self.replies.get(r.prompt, self.replies.get(r.statement))
            return Reply(self.on_failure, failed=True) if text is None else Reply(text)

        return call


@dataclass(frozen=True)
class ChatProvider:
    """An OpenAI-style chat endpoint. Any error is a failed call with the text on_failure."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.0
    timeout_s: float = 120.0
    options: dict[str, object] = field(default_factory=dict)
    name: str = "chat"
    on_failure: str = ""

    def body(self, r: Request) -> dict[str, object]:
        return {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": r.system}, {"role": "user", "content": r.prompt}], **self.options}

    def parse(self, answer: dict) -> tuple[str, int, int]:
        usage = answer.get("usage") or {}
        return (answer["choices"][0]["message"]["content"] or "").strip(), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)

    def open(self) -> Callable[[Request], Reply]:
        def call(r: Request) -> Reply:
            began = time.time()
            try:
                head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
                asked = urllib.request.Request(self.url, json.dumps(self.body(r)).encode(), head)
                with urllib.request.urlopen(asked, timeout=self.timeout_s) as f:
                    text, a, b = self.parse(json.load(f))
                return Reply(text, a, b, time.time() - began)
            except Exception:  # noqa: BLE001 - a failed call is a result here
                return Reply(self.on_failure, latency_s=time.time() - began, failed=True)

        return call


@dataclass(frozen=True)
class LocalServerProvider(ChatProvider):
    """A local model server's chat endpoint, without streaming; token counts come under its own names."""

    num_predict: int = 100
    num_ctx: int | None = 8192
    think: bool | None = None
    name: str = "local"

    def body(self, r: Request) -> dict[str, object]:
        options = {"temperature": self.temperature, "num_predict": self.num_predict, **({} if self.num_ctx is None else {"num_ctx": self.num_ctx}), **self.options}
        top = {} if self.think is None else {"think": self.think}
        return {"model": self.model, "stream": False, "messages": [{"role": "system", "content": r.system}, {"role": "user", "content": r.prompt}], "options": options, **top}

    def parse(self, answer: dict) -> tuple[str, int, int]:
        return ((answer.get("message") or {}).get("content") or "").strip(), answer.get("prompt_eval_count", 0), answer.get("eval_count", 0)


@dataclass(frozen=True)
class Retrying:
    """Another provider, asked again while the call fails or its reply does not match `accept`; tokens and time add up.

    After `tries` calls the last reply stands.
    """

    inner: Provider
    accept: str = ""
    tries: int = 3

    @property
    def name(self) -> str:
        return self.inner.name

    @property
    def on_failure(self) -> str:
        return self.inner.on_failure

    def open(self) -> Callable[[Request], Reply]:
        call, good = self.inner.open(), re.compile(self.accept, re.I)

        def retry(r: Request) -> Reply:
            prompt = completion = 0
            took = 0.0
            for _ in range(max(1, self.tries)):
                reply = call(r)
                prompt, completion, took = prompt + reply.prompt_tokens, completion + reply.completion_tokens, took + reply.latency_s
                if not reply.failed and good.search(reply.text):
                    break
            return replace(reply, prompt_tokens=prompt, completion_tokens=completion, latency_s=took)

        return retry


def _call(provider: Provider, pool: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        with ThreadPoolExecutor(pool) as threads:
            for batch in batches:
                if not len(batch):
                    continue
                call = call or provider.open()
                asked = [Request(*r) for r in batch[["phase", "system", "prompt", "statement", "context"]].fillna("").itertuples(index=False)]
                replies = list(threads.map(call, asked)) if pool > 1 else [call(r) for r in asked]
                yield pd.DataFrame({"request_key": batch["request_key"], "text": [r.text for r in replies], "prompt_tokens": [r.prompt_tokens for r in replies], "completion_tokens": [r.completion_tokens for r in replies], "latency_s": [r.latency_s for r in replies], "failed": [r.failed for r in replies]})

    return run


def prompt_of(statement: Column, context: Column | None) -> Column:
    """The user prompt of a request: the statement alone, or after its passage."""
    return statement if context is None else F.concat(F.lit("Passage: "), context, F.lit("\nStatement: "), statement)


def context_key(context: Column) -> Column:
    """What stands for a passage until the call: 128 bits of it."""
    return F.unhex(F.md5(F.coalesce(context, F.lit("")))).alias("context_key")


def ask(requests: DataFrame, provider: Provider, pool: int = 1, keep: Callable[[DataFrame], DataFrame] = cut, contexts: DataFrame | None = None) -> DataFrame:
    """requests with text, prompt_tokens, completion_tokens, latency_s and failed.

    Needs the columns phase, system, prompt, statement, context; null texts are read as ''. With contexts (context_key,
    context), requests have a context_key in place of prompt and context: the passages do not travel with the requests
    but join the distinct ones just before the call. Equal requests are called once: they are reduced to distinct keys
    before the calls and joined back, so tokens count per use; what was paid for is the sum over distinct keys. The
    calls' results are written before anything reads them (keep), as a plan with two readers would call twice. At most
    partitions x pool calls run at once.
    """
    texts = ["phase", "system", "statement"] + ([] if contexts is not None else ["prompt", "context"])
    whole = requests.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    parts = [*texts, *([F.hex("context_key")] if contexts is not None else [])]
    columns = [*texts, *(["context_key"] if contexts is not None else [])]
    keyed = whole.withColumn("request_key", F.unhex(F.md5(F.concat_ws("\u0001", F.lit(provider.name), *parts))))
    distinct = keyed.select("request_key", *columns).dropDuplicates(["request_key"])
    if contexts is not None:
        passages = contexts.select("context_key", F.coalesce("context", F.lit("")).alias("context")).dropDuplicates(["context_key"])
        distinct = distinct.join(passages, "context_key", "left").na.fill("", ["context"]).withColumn("prompt", prompt_of(F.col("statement"), F.col("context")))
    replies = keep(distinct.select("request_key", "phase", "system", "prompt", "statement", "context").mapInPandas(_call(provider, pool), REPLY))
    return keyed.join(replies, "request_key", "left").drop("request_key")


def replay(requests: DataFrame, table: DataFrame, keys: list[str], on_failure: str = "") -> DataFrame:
    """Replies from a table of stored calls (keys and text): a join, for any size; missing replies are failures."""
    out = requests.join(table.select(*keys, "text").dropDuplicates(keys), keys, "left")
    return out.withColumns({"failed": F.col("text").isNull(), "text": F.coalesce("text", F.lit(on_failure))})
