"""Text generation: a provider protocol, a runner over partitions, retries, and offline stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import ERROR, bare_words, uniform

PROVIDERS: dict[str, Callable[..., "Provider"]] = {}
# How each provider names the longest answer it may give.
LENGTH_NAMES = {"vertex": "max_output_tokens", "bedrock": "maxTokenCount"} | dict.fromkeys(["openai", "azure_openai", "anthropic", "cohere", "ai21", "inference_server", "open_router", "deep_infra"], "max_tokens")


class Provider(Protocol):
    def complete(self, prompt: str, **generation: object) -> str: ...


def provider(name: str) -> Callable[[Callable[..., Provider]], Callable[..., Provider]]:
    def add(make: Callable[..., Provider]) -> Callable[..., Provider]:
        PROVIDERS[name] = make
        return make

    return add


@provider("mock")
class Mock:
    """The words of the prompt from the last to the first."""

    def __init__(self, **_: object) -> None: ...

    def complete(self, prompt: str, **generation: object) -> str:
        return " ".join(prompt.split()[::-1])


class Http:
    """A provider behind an HTTP endpoint that takes {prompt} as JSON; retries with growing pauses."""

    def __init__(self, url: str, model: str, headers: dict | None = None, retries: int = 10, backoff: float = 2.0, timeout: float = 120.0, read: Callable[[dict], str] | None = None) -> None:
        self.url, self.model, self.headers, self.retries, self.backoff, self.timeout = url, model, headers or {}, retries, backoff, timeout
        self.read = read or (lambda body: body["choices"][0].get("text") or body["choices"][0]["message"]["content"])

    def complete(self, prompt: str, **generation: object) -> str:
        import json
        import urllib.request

        body = json.dumps({"model": self.model, "prompt": prompt, **generation}).encode()
        for n in range(self.retries + 1):
            try:
                request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return self.read(json.load(reply))
            except OSError:
                if n == self.retries:
                    raise
                time.sleep(self.backoff * 2**n)
        raise AssertionError


for _name in ("openai", "azure_openai", "anthropic", "cohere", "ai21", "vertex", "bedrock", "deep_infra", "hf_local", "hf_remote", "inference_server", "open_router"):
    PROVIDERS[_name] = Http


def length_parameters(provider_name: str, least: int, most: int, given: dict | None = None) -> dict:
    """The limits under the provider's names; what the configuration gives wins."""
    name = LENGTH_NAMES.get(provider_name)
    limits = {name: most} if name else {"max_new_tokens": most, "min_new_tokens": least}
    return limits | (given or {})


def generate(df: DataFrame, prompt_col: str, provider_name: str, threads: int = 8, generation: dict | None = None, **settings: object) -> DataFrame:
    """The rows with ``generation``: each task calls the provider from a small pool of threads; any failure gives <error>.

    Write the result before using it twice: a provider need not answer the same again.
    """
    make, options = PROVIDERS[provider_name], generation or {}
    schema = df.withColumn("generation", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make(**settings)

        def one(prompt: str | None) -> str:
            try:
                return model.complete(prompt or "", **options)
            except Exception:  # noqa: BLE001 - every failure of a provider is one kind of row
                return ERROR

        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                yield pdf.assign(generation=list(pool.map(one, pdf[prompt_col])))

    return df.mapInPandas(run, schema)


def mock_completion(prompt: Column, key: Column) -> Column:
    """The stand-in as an expression: reversed words, and an error for one key in twenty."""
    return F.when(uniform(77, key) < 0.05, ERROR).otherwise(F.array_join(F.reverse(bare_words(prompt)), " "))


def mock_masks(n: Column, key: Column) -> Column:
    """A JSON object with a text for each of n masks; damaged for one key in twenty."""
    names = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    body = F.to_json(F.map_from_arrays(F.transform(names, lambda i: F.concat(F.lit("MASK-"), i.cast("string"))), F.transform(names, lambda i: F.concat(F.lit("text "), i.cast("string")))))
    return F.when(uniform(78, key) < 0.05, F.lit('{"MASK-0": "te')).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" done")))
