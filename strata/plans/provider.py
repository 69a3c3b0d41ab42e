"""Calls to language models as columns: text or JSON replies, and what went wrong by name.

A provider is a callable from prompt to reply, or an object whose ``generate_json(prompt,
schema)`` asks for structured output; it must travel to the executors.  Errors never carry a
provider's own words.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions import text

REPLY = "struct<text:string,error:string>"
DECISION_SCHEMA = {"type": "object", "properties": {"decision": {"type": "string"}, "reason": {"type": "string"}}, "required": ["decision"]}
#: What an exception counts as: the first that fits.
ERRORS = ((TimeoutError, "timeout"), (ConnectionError, "unavailable"), ((ValueError, TypeError), "invalid_response"), (Exception, "request_failed"))


def error_of(e: Exception) -> str:
    return next(name for kind, name in ERRORS if isinstance(e, kind))


def _replies(prompt: Column, call: Callable[[str], str]) -> Column:
    def one(p: str | None) -> dict:
        if p is None or not p.strip():
            return {"text": None, "error": "empty_prompt"}
        try:
            said = call(p)
        except Exception as e:  # noqa: BLE001  mapped to a name
            return {"text": None, "error": error_of(e)}
        if not isinstance(said, str) or not said.strip():
            return {"text": None, "error": "invalid_response"}
        return {"text": said.strip(), "error": None}

    kind = pa.struct([("text", pa.string()), ("error", pa.string())])

    @F.arrow_udf(REPLY)
    def run(prompts: pa.Array) -> pa.Array:
        return pa.array([one(p) for p in prompts.to_pylist()], kind)

    return run(prompt)


def generate(prompt: Column, provider: Callable[[str], str]) -> Column:
    """(text, error) of a reply to each prompt; one of the two is null."""
    return _replies(prompt, provider)


def generate_json(prompt: Column, provider: object, schema: dict) -> Column:
    """(text, error) with the JSON object of each reply; one without the schema's required keys is an invalid response.

    Providers without structured output are asked for plain text, from which the object is taken.
    """
    ask = getattr(provider, "generate_json", None)
    call = (lambda p: ask(p, schema)) if ask else provider
    said = _replies(prompt, call)
    found = text.json_object(said["text"])
    whole = found.isNotNull()
    for key in schema.get("required", []):
        whole = whole & F.get_json_object(found, f"$.{key}").isNotNull()
    error = F.when(said["error"].isNotNull(), said["error"]).when(~F.coalesce(whole, F.lit(False)), "invalid_response")
    return F.struct(F.when(error.isNull(), found).alias("text"), error.alias("error"))


def decisions(provider: object) -> Callable[[Column], Column]:
    """The reply column that ``ladder.verify_ladder`` takes, by JSON with a decision; errors are null, hence unsupported."""
    return lambda prompt: generate_json(prompt, provider, DECISION_SCHEMA)["text"]


# --- the service's state ---------------------------------------------------------------


def health(service: str) -> dict:
    return {"status": "ok", "service": service}


def release(service: str, release_id: str, version: str) -> dict:
    """What tells one deployment from another, without secrets."""
    return {"service": service, "release": release_id, "version": version}


def model_status(name: str, model: str, probe: Callable[[], dict]) -> dict:
    """ready, model_missing or unavailable, by what ``probe`` says (reachable, model_configured, reason) or raises."""
    try:
        found = probe()
    except Exception as e:  # noqa: BLE001  mapped to a name
        found = {"reachable": False, "reason": error_of(e)}
    if not found.get("reachable"):
        return {"status": "unavailable", "provider": name, "model": model, "reason": found.get("reason", "unavailable")}
    return {"status": "ready" if found.get("model_configured") else "model_missing", "provider": name, "model": model}
