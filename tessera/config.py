"""Settings as frozen sections, from dictionaries or YAML, with closed vocabularies."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from tessera.errors import ConfigError, MissingDependencyError

#: Allowed values of settings that have a closed vocabulary.
ALLOWED = {
    "data.task": ("regression", "classification"),
    "frontend.window": ("hamming_symmetric", "hamming", "hann", "rectangular"),
    "frontend.energy": ("c0", "log_energy", "none"),
    "frontend.delta_order": (0, 1, 2),
    "pooling.normalization": ("none", "cmn", "cmvn"),
    "analysis.correction": ("holm", "fdr_bh"),
    "analysis.stepwise_start": ("empty", "full"),
    "model.name": ("linear", "ridge", "svr", "random_forest", "mlp", "logistic", "svc"),
    "model.reducer": ("none", "pca", "lda"),
}


@dataclass(frozen=True)
class Data:
    task: str = "regression"
    target: str = "severity"
    folds: int = 5
    repeats: int = 1
    seed: int = 0
    group: str = ""
    positive: str = ""


@dataclass(frozen=True)
class Frontend:
    frame_ms: float = 30.0
    hop_ms: float = 15.0
    mels: int = 23
    coefficients: int = 12
    window: str = "hamming_symmetric"
    energy: str = "c0"
    delta_order: int = 2
    low: float = 64.0
    high: float | None = None
    emphasis: float = 0.97
    lifter: int = 22
    floor: float = 1e-10
    trim: float = 0.0
    preset: str = ""


@dataclass(frozen=True)
class Pooling:
    statistics: tuple[str, ...] = ("mean", "std")
    percentiles: tuple[float, ...] = ()
    normalization: str = "none"


@dataclass(frozen=True)
class Analysis:
    confidence: float = 0.95
    correction: str = "holm"
    p_enter: float = 0.05
    p_remove: float = 0.10
    stepwise_start: str = "empty"
    degrees: int = 4


@dataclass(frozen=True)
class Model:
    name: str = "ridge"
    alpha: float = 1.0
    settings: dict = field(default_factory=dict)
    reducer: str = "none"
    tune: bool = False
    inner: int = 3


@dataclass(frozen=True)
class Ablation:
    axes: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    data: Data = field(default_factory=Data)
    frontend: Frontend = field(default_factory=Frontend)
    pooling: Pooling = field(default_factory=Pooling)
    analysis: Analysis = field(default_factory=Analysis)
    model: Model = field(default_factory=Model)
    ablation: Ablation = field(default_factory=Ablation)

    def model_settings(self) -> dict:
        """What the model is fitted with: ridge's penalty, and any other settings by name."""
        return ({"alpha": self.model.alpha} if self.model.name == "ridge" else {}) | dict(self.model.settings)

    def __post_init__(self):
        for key, allowed in ALLOWED.items():
            section, name = key.split(".")
            if (value := getattr(getattr(self, section), name)) not in allowed:
                raise ConfigError(f"{key} must be one of {', '.join(map(str, allowed))}, got {value!r}")
        if self.data.folds < 2:
            raise ConfigError("data.folds must be 2 at least")
        if self.model.inner < 2:
            raise ConfigError("model.inner must be 2 at least")

    @classmethod
    def from_dict(cls, values: Mapping) -> Config:
        return cls().override(values)

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        try:
            import yaml
        except ImportError as e:
            raise MissingDependencyError("reading YAML needs the library yaml") from e
        return cls.from_dict(yaml.safe_load(text) or {})

    def to_dict(self) -> dict:
        return asdict(self)

    def override(self, values: Mapping) -> Config:
        """A copy with other values; an unknown key is an error that lists the known ones."""
        return _override(self, values, "")


def _override(section, values: Mapping, prefix: str):
    known = {f.name for f in fields(section)}
    if unknown := sorted(set(values) - known):
        raise ConfigError(f"unknown settings {', '.join(prefix + u for u in unknown)}; known: {', '.join(sorted(known))}")
    new = {}
    for k, v in values.items():
        old = getattr(section, k)
        if isinstance(old, float) and isinstance(v, str):  # YAML reads 1e-10 as text
            try:
                v = float(v)
            except ValueError:
                raise ConfigError(f"{prefix}{k} must be a number, got {v!r}") from None
        new[k] = _override(old, v, f"{prefix}{k}.") if is_dataclass(old) else dict(v) if isinstance(v, Mapping) else tuple(v) if isinstance(v, list) else v
    return replace(section, **new)


_WORDS = {"true": True, "false": False, "none": None}


def coerce(text: str):
    """A command line's value: one of the words true, false and none, a JSON value, or else the text itself."""
    import json

    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text
