"""Bodies of requests and answers of hosted models that share one endpoint, by vendor; pure functions."""

from __future__ import annotations

# Where each vendor's answer holds the text.
ANSWER_AT: dict[str, tuple[str | int, ...]] = {
    "ai21": ("completions", 0, "data", "text"),
    "amazon": ("results", 0, "outputText"),
    "anthropic": ("completion",),
    "cohere": ("generations", 0, "text"),
    "meta": ("generation",),
    "mistral": ("outputs", 0, "text"),
}


def vendor(model_name: str) -> str:
    """The part of a model's name before the first point."""
    name = model_name.split(".", 1)[0]
    if name not in ANSWER_AT:
        raise ValueError(f"unknown vendor {name!r}")
    return name


def request(model_name: str, prompt: str, generation: dict) -> dict:
    who = vendor(model_name)
    if who == "amazon":
        return {"inputText": prompt, "textGenerationConfig": dict(generation)}
    if who == "anthropic":
        return {"prompt": f"\n\nHuman: {prompt}\n\nAssistant:", **generation}
    return {"prompt": prompt, **generation}


def answer(model_name: str, body: dict) -> str:
    out: object = body
    for key in ANSWER_AT[vendor(model_name)]:
        out = out[key]  # type: ignore[index]
    return str(out)
