"""Settings as frozen dataclasses, with a JSON form.

A setting is written as its name with its fields, ``{"Okapi": {"k1": 1.2, "b":
0.75}}``, or as its name alone where it has none, ``"TfIdf"``.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


class Setting:
    """Base of all settings that are written with their name as a tag."""

    _tags: dict[str, type] = {}
    tag = ""

    def __init_subclass__(cls, tag: str = "", **kw: Any) -> None:
        super().__init_subclass__(**kw)
        cls.tag = tag or cls.__name__
        Setting._tags[cls.tag] = cls

    def dump(self) -> Any:
        body = {f.name: plain(getattr(self, f.name)) for f in fields(self)}  # type: ignore[arg-type]
        return {self.tag: body} if body else self.tag


def plain(value: Any) -> Any:
    """A setting, or anything that holds some, as JSON types."""
    if isinstance(value, Setting):
        return value.dump()
    if is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    return value


def parse(value: Any) -> Setting:
    """The setting that ``dump`` wrote; unknown names raise ValueError."""
    if isinstance(value, Setting):
        return value
    name, body = (value, {}) if isinstance(value, str) else next(iter(value.items()))
    kind = Setting._tags.get(name)
    if kind is None:
        raise ValueError(f"unknown setting: {name}")
    if name == "F":
        body = {**body, "fields": tuple(FieldWeight(**f) for f in body.get("fields", ()))}
    return kind(**body)


# -- scoring -------------------------------------------------------------------


@dataclass(frozen=True)
class FieldWeight:
    name: str
    weight: float = 1.0
    b: float = 0.75


@dataclass(frozen=True)
class Okapi(Setting):
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class Plus(Setting):
    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.5


@dataclass(frozen=True)
class Bm25L(Setting, tag="L"):
    k1: float = 1.2
    b: float = 0.75
    c: float = 1.0


@dataclass(frozen=True)
class Adaptive(Setting, tag="Adpt"):
    b: float = 0.75


@dataclass(frozen=True)
class Bm25F(Setting, tag="F"):
    k1: float = 1.2
    b: float = 0.75
    fields: tuple[FieldWeight, ...] = ()


@dataclass(frozen=True)
class Bm25T(Setting, tag="T"):
    default_k1: float = 1.2
    b: float = 0.75
    term_k1: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Atire(Setting):
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class TfIdf(Setting):
    pass


ALL_SCORERS = (Okapi(), Plus(), Bm25L(), Adaptive(), Bm25F(), Bm25T(), Atire(), TfIdf())

# -- retrieval -----------------------------------------------------------------


@dataclass(frozen=True)
class ExhaustiveDAAT(Setting):
    pass


@dataclass(frozen=True)
class ExhaustiveTAAT(Setting):
    pass


@dataclass(frozen=True)
class Wand(Setting):
    top_k_budget: int = 0


@dataclass(frozen=True)
class BlockMaxWand(Setting):
    top_k_budget: int = 0


@dataclass(frozen=True)
class MaxScore(Setting):
    pass


# -- analysis ------------------------------------------------------------------


@dataclass(frozen=True)
class Whitespace(Setting):
    pass


@dataclass(frozen=True)
class UnicodeWord(Setting):
    pass


@dataclass(frozen=True)
class Regex(Setting):
    pattern: str = r"\w+"


@dataclass(frozen=True)
class Ngram(Setting):
    min_n: int = 3
    max_n: int = 3
    mode: str = "Character"


@dataclass(frozen=True)
class Lowercase(Setting):
    pass


@dataclass(frozen=True)
class Stopwords(Setting):
    lang: str = "en"


@dataclass(frozen=True)
class Length(Setting):
    min_len: int = 1
    max_len: int = 128


@dataclass(frozen=True)
class DuplicateCap(Setting):
    max_per_doc: int = 32


@dataclass(frozen=True)
class NoOp(Setting):
    pass


@dataclass(frozen=True)
class Porter(Setting):
    """The Snowball English stemmer, under the name that users know."""


@dataclass(frozen=True)
class Snowball(Setting):
    lang: str = "en"


@dataclass(frozen=True)
class TokenizerConfig:
    tokenizer: Setting = Whitespace()
    filters: tuple[Setting, ...] = (Lowercase(), Stopwords("en"))
    stemmer: Setting = NoOp()
    min_token_len: int = 1
    max_token_len: int = 128

    @classmethod
    def from_mapping(cls, m: Mapping[str, Any]) -> TokenizerConfig:
        """Missing filters mean lower-casing alone, unlike in the constructor."""
        return cls(
            parse(m.get("tokenizer", "Whitespace")),
            tuple(parse(f) for f in m.get("filters", ["Lowercase"])),
            parse(m.get("stemmer", "NoOp")),
            m.get("min_token_len", 1),
            m.get("max_token_len", 128),
        )


@dataclass(frozen=True)
class ExpansionConfig:
    method: str = "RM3"
    num_feedback_docs: int = 10
    num_expansion_terms: int = 10


@dataclass(frozen=True)
class FusionConfig:
    method: str = "ReciprocalRankFusion"
    alpha: float = 0.5
    normalizer: str | None = "Cdf"
    rrf_k: int = 60


@dataclass(frozen=True)
class PersistConfig:
    load_mode: str = "in_memory"
    enable_wal: bool = False
    compression: bool = True


@dataclass(frozen=True)
class BM25Config:
    scoring: Setting = Okapi()
    tokenizer: TokenizerConfig = TokenizerConfig()
    retrieval: Setting = BlockMaxWand()

    def to_json(self) -> str:
        return json.dumps(plain(self), sort_keys=True)

    @classmethod
    def from_mapping(cls, m: Mapping[str, Any]) -> BM25Config:
        return cls(
            parse(m.get("scoring", Okapi())),
            TokenizerConfig.from_mapping(m.get("tokenizer", {})),
            parse(m.get("retrieval", BlockMaxWand())),
        )
