"""Seams for models: a protocol, retries, and batched calls. Replies are parsed by Spark."""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.index import shared_folder

#: Fixed values.
RETRIABLE = [408, 409, 429, 500, 502, 503, 504]
ATTEMPTS, PAUSE = 3, 5.0


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class ProviderError(Exception):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_retries(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
    """Tries again after transport errors and the statuses of RETRIABLE, each time after a longer pause."""
    for n in range(ATTEMPTS):
        try:
            return call()
        except ProviderError as e:
            if n == ATTEMPTS - 1 or (e.status is not None and e.status not in RETRIABLE):
                raise
            sleep(PAUSE * (n + 1))
    raise AssertionError


def complete_all(rows: DataFrame, prompt: str, make: Callable[[], Completer]) -> DataFrame:
    """rows with `reply`; each task makes its own provider. A row whose call fails for good gets a null reply and `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for batch in batches:
            replies, errors = [], []
            for p in batch.column(prompt).to_pylist():
                try:
                    replies.append(with_retries(lambda p=p: provider.complete(p)))
                    errors.append(None)
                except ProviderError as e:
                    replies.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "reply", "error"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]))


def complete_once(rows: DataFrame, prompt: str, make: Callable[[], Completer], path: str | None = None) -> DataFrame:
    """complete_all, written and read again, so that nothing that follows calls the model anew. path: by default a new folder in the shared one."""
    spark = rows.sparkSession
    path = path or os.path.join(shared_folder(spark), f"larkspur-replies-{uuid.uuid4().hex}")
    complete_all(rows, prompt, make).write.parquet(path)
    return spark.read.parquet(path)


def parse_reply(reply: Column, schema: str) -> Column:
    """The JSON object of a reply: without its code fence, else from the first brace to the last."""
    bare = F.regexp_replace(F.trim(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")
    whole = F.when(bare.startswith("{"), F.from_json(bare, schema))
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull(), whole), F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), schema))


class Service(NamedTuple):
    """Where a model is reached, and how its requests look: chat (messages) or generate (one prompt)."""

    name: str
    url: str
    shape: str
    text_model: str
    vision_model: str | None
    key_env: str | None


#: Addresses, models and the variables that hold keys.
SERVICES = {
    "deepseek": Service("deepseek", "https://api.deepseek.com/chat/completions", "chat", "deepseek-chat", None, "DEEPSEEK_API_KEY"),
    "openai": Service("openai", "https://api.openai.com/v1/chat/completions", "chat", "gpt-4o", "gpt-4o", "OPENAI_API_KEY"),
    "ollama": Service("ollama", "http://localhost:11434/api/generate", "generate", "qwen2.5:7b", "qwen2.5vl:7b", None),
}
DEFAULT = "deepseek"
Post = Callable[[str, dict, dict], dict]


def service(name: str | None = None) -> Service:
    """By name, else by LARKSPUR_PROVIDER; models may be set by LARKSPUR_TEXT_MODEL and LARKSPUR_VISION_MODEL. The environment is read anew each time."""
    key = (name or os.environ.get("LARKSPUR_PROVIDER", DEFAULT)).strip().lower()
    if key not in SERVICES:
        raise ProviderError(f"unknown provider {key!r}; there are {', '.join(sorted(SERVICES))}")
    found = SERVICES[key]
    return found._replace(text_model=os.environ.get("LARKSPUR_TEXT_MODEL") or found.text_model, vision_model=os.environ.get("LARKSPUR_VISION_MODEL") or found.vision_model)


def require_ready(s: Service, vision: bool = False) -> None:
    """For the driver, before the job: a missing key or model should not fail a thousand tasks."""
    if s.key_env and not os.environ.get(s.key_env):
        raise ProviderError(f"{s.name} wants {s.key_env} to be set")
    if vision and not s.vision_model:
        raise ProviderError(f"{s.name} has no vision model")


def payload(s: Service, prompt: str, image: bytes | None = None, as_json: bool = True, temperature: float = 0.0, max_tokens: int = 4096) -> dict:
    """The body of a request, with a PNG where an image is given."""
    shown = base64.b64encode(image).decode() if image is not None else None
    model = s.text_model if image is None else s.vision_model
    if s.shape == "generate":
        return {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature}} | ({"images": [shown]} if shown else {}) | ({"format": "json"} if as_json else {})
    content = [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{shown}"}}] if shown else prompt
    return {"model": model, "messages": [{"role": "user", "content": content}], "temperature": temperature, "max_tokens": max_tokens} | ({"response_format": {"type": "json_object"}} if as_json else {})


def reply_of(s: Service, response: dict) -> str:
    return response.get("response", "") if s.shape == "generate" else response["choices"][0]["message"]["content"]


def http_post(url: str, headers: dict, body: dict, timeout: float = 120.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise ProviderError(str(e), e.code) from e
    except OSError as e:
        raise ProviderError(str(e)) from e


class HttpCompleter:
    """A completer over HTTP; `post` may be replaced in tests."""

    def __init__(self, s: Service, post: Post = http_post):
        self.service, self.post = s, post

    def complete(self, prompt: str, image: bytes | None = None) -> str:
        key = os.environ.get(self.service.key_env) if self.service.key_env else None
        headers = {"Authorization": f"Bearer {key}"} if key else {}
        return reply_of(self.service, self.post(self.service.url, headers, payload(self.service, prompt, image)))

    def describe(self) -> str:
        return f"{self.service.name}: {self.service.text_model}" + (f", {self.service.vision_model} for images" if self.service.vision_model else "")
