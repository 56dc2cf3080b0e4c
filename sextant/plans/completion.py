"""Completion routing: strategies, cache, fallback and statistics over any providers, and a batch form for tables of prompts."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.errors import ErrorCode, StoreError

STRATEGIES = ("local_only", "cloud_only", "local_first", "cloud_first", "latency_optimized", "quality_optimized")
LOCAL_MS, CLOUD_MS, SMOOTHING = 100.0, 1000.0, 0.3


@dataclass(frozen=True)
class Request:
    messages: tuple[tuple[str, str], ...]  # (role, text)
    system: str = ""
    max_tokens: int = 256
    temperature: float = 0.2
    stop: tuple[str, ...] = ()
    model: str = ""


class Provider(Protocol):
    name: str
    is_local: bool

    def is_available(self) -> bool: ...

    def complete(self, request: Request) -> str: ...


@dataclass
class CompletionRouter:
    local: list[Provider] = field(default_factory=list)
    cloud: list[Provider] = field(default_factory=list)
    strategy: str = "local_first"
    cache_size: int = 100
    cache_seconds: float = 300.0
    retries: int = 2
    retry_seconds: float = 0.1
    context_limit: int = 1000
    complexity_limit: int = 50
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        self._cache: OrderedDict[Request, tuple[float, str]] = OrderedDict()
        self.latency: dict[str, float] = {}
        self.stats = {"requests": 0, "cache_hits": 0, "failures": 0, "mean_ms": 0.0, "local": 0, "cloud": 0}

    def complexity(self, request: Request) -> int:
        tokens = sum(len(text.encode()) // 4 for _, text in request.messages)
        return self.complexity_limit + 1 if tokens > self.context_limit else request.max_tokens

    def select(self, request: Request) -> Provider | None:
        here, there = ([p for p in ps if p.is_available()] for ps in (self.local, self.cloud))
        if self.strategy == "latency_optimized":
            expected = lambda p: self.latency.get(p.name, LOCAL_MS if p.is_local else CLOUD_MS)
            return min(here + there, key=expected, default=None)
        hard = self.complexity(request) > self.complexity_limit or len(request.messages) > 2
        order = {
            "local_only": here,
            "cloud_only": there,
            "local_first": here + there,
            "cloud_first": there + here,
            "quality_optimized": there + here if hard else here + there,
        }[self.strategy]
        return order[0] if order else None

    def fallback(self, failed: Provider) -> Provider | None:
        """Another provider: the cloud for a local one, else a local one, else any."""
        groups = (self.cloud, self.local) if failed.is_local else (self.local, self.cloud)
        return next((p for ps in groups for p in ps if p is not failed and p.is_available()), None)

    def _cached(self, request: Request) -> str | None:
        if (hit := self._cache.get(request)) is None:
            return None
        if self.clock() - hit[0] > self.cache_seconds:
            del self._cache[request]
            return None
        return hit[1]

    def _record(self, provider: Provider, ms: float) -> None:
        old = self.latency.get(provider.name)
        self.latency[provider.name] = ms if old is None else SMOOTHING * ms + (1 - SMOOTHING) * old
        self.stats["local" if provider.is_local else "cloud"] += 1
        done = self.stats["local"] + self.stats["cloud"]
        self.stats["mean_ms"] += (ms - self.stats["mean_ms"]) / done

    def complete(self, request: Request) -> str:
        self.stats["requests"] += 1
        if (text := self._cached(request)) is not None:
            self.stats["cache_hits"] += 1
            return text
        provider = self.select(request)
        if provider is None:
            raise StoreError(ErrorCode.NOT_FOUND, "no provider is available")
        for attempt in range(self.retries + 1):
            began = self.clock()
            try:
                text = provider.complete(request)
            except Exception as error:
                self.stats["failures"] += 1
                provider = self.fallback(provider) or provider
                if attempt == self.retries:
                    raise StoreError(ErrorCode.NETWORK_ERROR, str(error)) from error
                time.sleep(self.retry_seconds)
                continue
            self._record(provider, 1000 * (self.clock() - began))
            self._cache[request] = (self.clock(), text)
            while len(self._cache) > self.cache_size:
                self._cache.popitem(last=False)
            return text
        raise StoreError(ErrorCode.INTERNAL_ERROR)

    def complete_code(self, context: str, language: str = "") -> str:
        ask = f"Complete this {language} code:\n{context}" if language else f"Complete this code:\n{context}"
        return self.complete(Request((("user", ask),), max_tokens=256, temperature=0.2))

    def generate(self, text: str, language: str = "") -> str:
        ask = f"Write {language} code for: {text}" if language else f"Write code for: {text}"
        return self.complete(Request((("user", ask),), max_tokens=1024, temperature=0.3))

    def complete_with(self, name: str, request: Request) -> str:
        for p in self.local + self.cloud:
            if p.name == name:
                return p.complete(request)
        raise StoreError(ErrorCode.NOT_FOUND, name)


def complete_table(prompts: DataFrame, complete: Callable[[list[str]], list[str]], column: str = "prompt") -> DataFrame:
    """``prompts`` with a column ``completion``: each distinct prompt is asked once, batch by batch on the executors."""

    def run(parts: Iterator) -> Iterator:
        for part in parts:
            part["completion"] = complete(part[column].tolist())
            yield part

    asked = prompts.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, completion string")
    return prompts.join(asked, column, "left")


def prompt_template(turns: DataFrame) -> DataFrame:
    """(conv_id, prompt): role-tagged turns in order, then the assistant's tag."""
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")
    return lists.select("conv_id", F.concat(text, F.lit("<|assistant|>\n")).alias("prompt"))


def complexity(turns: DataFrame, max_tokens: int = 256, context_limit: int = 1000, complexity_limit: int = 50) -> DataFrame:
    """(conv_id, value): one over the limit for a long context, else the tokens asked for."""
    tokens = F.sum(F.floor(F.octet_length("text") / 4))
    return turns.groupBy("conv_id").agg(F.when(tokens > context_limit, complexity_limit + 1).otherwise(max_tokens).cast("long").alias("value"))


def smoothed(values: Column, alpha: float = SMOOTHING) -> Column:
    """Exponential moving average over an ordered array of doubles; the first value starts it."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1), lambda a, x: alpha * x + (1 - alpha) * a)
