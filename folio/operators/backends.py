"""Named-entity backends: a registry of models that tag tokens, run in Arrow batches.

A backend tells how to load its model and whether it can be loaded here. The model is loaded once in each Python worker, at its first batch, and tags sentences a few hundred at a time; its tokens
(which may join words by ``_``) go through ``ner.decode_bio``, which finds their places in the sentence. ``capitals`` is a small deterministic model without any library.
"""

from __future__ import annotations

import sys
import types
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from .ner import decode

#: Sentences that a model tags at once.
BATCH = 256
#: Backends that ``auto`` prefers to the rules, in this order.
PREFERRED = ["vncorenlp", "phobert"]
TAGGED = "array<struct<token:string,tag:string>>"


class Tagger(Protocol):
    def tag(self, sentences: list[str]) -> list[list[tuple[str, str]]]:
        """(token, BIO tag) of every token of every sentence."""


@dataclass(frozen=True)
class Backend:
    """``load`` makes the model; ``missing`` says why that can't be done here, None if it can."""

    name: str
    load: Callable[[], Tagger]
    score: float = 0.8
    missing: Callable[[], str | None] = lambda: None


_BACKENDS: dict[str, Backend] = {}


def register(backend: Backend) -> Backend:
    if backend.name in ("simple", "none", "auto"):
        raise ValueError(f"{backend.name!r} is taken")
    _BACKENDS[backend.name] = backend
    return backend


def choose(name: str) -> Backend | None:
    """The backend of a name; None for ``simple`` and ``none``, which need no model. ``auto`` takes the first preferred one that can be loaded, else none; asked for by
    name, a backend that can't be loaded is an error."""
    if name in ("simple", "none"):
        return None
    if name == "auto":
        return next((b for n in PREFERRED if (b := _BACKENDS.get(n)) and not b.missing()), None)
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}: use simple, auto, none or one of {sorted(_BACKENDS)}")
    reason = _BACKENDS[name].missing()
    if reason:
        raise RuntimeError(f"backend {name!r}: {reason}")
    return _BACKENDS[name]


def _loaded(backend: Backend) -> Tagger:
    """The model of this process; a worker serves many tasks."""
    models = sys.modules.setdefault("_folio_models", types.ModuleType("_folio_models")).__dict__
    if backend.name not in models:
        models[backend.name] = backend.load()
    return models[backend.name]


def _tagged(backend: Backend, texts: list[str | None]) -> list[list[tuple[str, str]]]:
    asked = [k for k, t in enumerate(texts) if t and not t.isspace()]
    tags: list[list[tuple[str, str]]] = [[] for _ in texts]
    if asked:
        found = _loaded(backend).tag([texts[k] for k in asked])
        if len(found) != len(asked):
            raise ValueError(f"backend {backend.name!r} tagged {len(found)} of {len(asked)} sentences")
        for k, tokens in zip(asked, found):
            tags[k] = tokens
    return tags


def with_tags(rows: DataFrame, backend: Backend, sentence: str = "sentence", out: str = "tagged") -> DataFrame:
    """``rows`` with the tagged tokens of a sentence column; none for a null or blank sentence."""
    names = rows.columns
    kind = pa.list_(pa.struct([("token", pa.string()), ("tag", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                tags = [[{"token": t, "tag": g} for t, g in tokens] for tokens in _tagged(backend, part.column(sentence).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tags, kind)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {out} {TAGGED}")


def with_entities(rows: DataFrame, backend: Backend, sentence: str = "sentence", out: str = "entities") -> DataFrame:
    """``rows`` with the entities of the tagged tokens of a sentence column, found in the same batches; see ``ner.decode_bio``."""
    names = rows.columns
    fields = [("label", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = part.column(sentence).to_pylist()
                found, offsets = [], [0]
                for text, tokens in zip(texts, _tagged(backend, texts)):
                    found += [(label, text[a : max(a, b)], a, b, backend.score) for label, a, b in decode(text, tokens)] if tokens else []
                    offsets.append(len(found))
                columns = list(zip(*found)) or [[]] * len(fields)
                items = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], names=[*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, {out} array<struct<label:string,text:string,start:int,end:int,score:double>>")


class Capitals:
    """Runs of capitalised words are persons."""

    #: What is stripped from a token.
    EDGE = ".,:;!?()[]{}\"'“”‘’"

    def _is_name(self, token: str) -> bool:
        c = token.strip(self.EDGE)
        if not c or unicodedata.category(c[0]) not in ("Lu", "Lt"):
            return False
        shout = c.upper() == c and c.lower() != c
        return not shout and not any(unicodedata.category(x) == "Nd" for x in c)

    def tag(self, sentences: list[str]) -> list[list[tuple[str, str]]]:
        out = []
        for s in sentences:
            tokens, inside = [], False
            for t in s.split():
                name = self._is_name(t)
                tokens.append((t, "O" if not name else "I-PER" if inside else "B-PER"))
                inside = name
            out.append(tokens)
        return out


register(Backend("capitals", Capitals))
