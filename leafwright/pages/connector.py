"""A model behind a local HTTP endpoint, as a callable for :mod:`leafwright.pages.assist`."""

from __future__ import annotations

import json
from dataclasses import dataclass

PROMPT = """Read the visible text of a web page and answer with one JSON object and nothing else.
Keys: "title" (the headline of the article, without the site's name, or null), "authors" (a list of the names in its byline; no media, sites, sections, bodies or people who are written about),
"publish_time" (as the page writes it, with the clock if there is one, or null). Take only what stands in the text.

Text:
<<<
{text}
>>>
"""


@dataclass(frozen=True)
class HttpModel:
    """Posts a prompt and reads a JSON object from the answer's field; the callers count any failure. ``longest`` bounds what a model is shown of a page, null doesn't."""

    url: str
    model: str
    prompt: str = PROMPT
    field: str = "response"
    timeout: float = 120.0
    longest: int | None = None

    def __call__(self, text: str) -> dict | None:
        from urllib.request import Request, urlopen

        asked = {"model": self.model, "prompt": self.prompt.replace("{text}", text[: self.longest]), "format": "json", "stream": False, "options": {"temperature": 0}}
        with urlopen(Request(self.url, json.dumps(asked).encode(), {"Content-Type": "application/json"}), timeout=self.timeout) as answer:  # noqa: S310
            got = json.loads(json.loads(answer.read())[self.field])
        return got if isinstance(got, dict) else None
