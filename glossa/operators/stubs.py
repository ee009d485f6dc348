"""Deterministic stand-ins for remote and local models (no network, no weights).

They let the scoring operators run end to end in tests and in the registered
queries, and their outputs are simple functions of the text so SQL can check
them. Lengths are UTF-8 byte lengths.
"""

from __future__ import annotations

import json

import numpy as np


def _nbytes(text) -> int:
    return len(text.encode("utf-8")) if isinstance(text, str) else 0


def stub_answer(text) -> str | None:
    """``Feedback: stub [RESULT] <bytes % 7>`` — exercises the clamp at both ends."""
    if text is None:
        return None
    return f"Feedback: stub [RESULT] {_nbytes(text) % 7}"


class EchoClient:
    """Chat client: answers every request with ``stub_answer``; fails when bytes % 11 == 0."""

    def __call__(self, request: dict, timeout: float | None = None) -> str:
        content = request["messages"][-1]["content"]
        if _nbytes(content) % 11 == 0:
            raise RuntimeError("stub failure")
        return json.dumps({"object": "chat.completion", "model": request["model"],
                           "choices": [{"index": 0, "message": {"role": "assistant",
                                                                "content": stub_answer(content)}}]},
                          ensure_ascii=False)


class FlakyClient(EchoClient):
    """Fails the first ``k`` calls for each request in this process, then answers."""

    def __init__(self, k: int = 2):
        self.k = k
        self.seen: dict[str, int] = {}

    def __call__(self, request: dict, timeout: float | None = None) -> str:
        key = request["model"] + "\x01" + request["messages"][-1]["content"]
        n = self.seen.get(key, 0)
        self.seen[key] = n + 1
        if n < self.k:
            raise TimeoutError("stub timeout")
        return super().__call__(request, timeout)


class StubJudge:
    def generate(self, prompts: list, sampling: dict) -> list:
        return [stub_answer(p) for p in prompts]


class LengthRatioScorer:
    """Segment scorer: byte-length ratio of the shorter to the longer text.

    One error span (``major``) when the translation is under half the source length.
    """

    def predict(self, samples: list[dict]):
        scores, spans = [], []
        for s in samples:
            a, b = _nbytes(s.get("src")), _nbytes(s.get("mt"))
            hi = max(a, b)
            scores.append(min(a, b) / hi if hi else 0.0)
            spans.append([{"text": "", "start": 0, "end": b, "severity": "major"}] if 2 * b < a else [])
        return scores, spans


class LetterEncoder:
    """Counts of the letters a, b, c, ... in the text, scaled to unit length (a stand-in
    that SQL can compute too)."""

    def __init__(self, dim: int = 16):
        self.letters = [chr(97 + i) for i in range(dim)]

    def encode(self, texts: list) -> list:
        x = np.array([[(t or "").count(c) for c in self.letters] for t in texts], dtype=np.float64)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return (x / np.where(n > 0, n, 1.0)).astype(np.float32).tolist()
