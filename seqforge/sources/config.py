"""Settings as frozen dataclasses, and loading them from YAML text.

Defaults are what applies when a setting is absent; ``SHIPPED`` holds the values of the
sample configuration.
"""

from __future__ import annotations

import dataclasses
import os.path
from dataclasses import dataclass, field


class ConfigError(ValueError):
    """A setting is missing or has an impossible value."""


@dataclass(frozen=True)
class Codec:
    name: str
    probability: float
    quality: tuple[int, int]
    presets: tuple[str, ...] = ()
    preset_range: tuple[int, int] | None = None

    def __post_init__(self):
        if self.quality[0] > self.quality[1]:
            raise ConfigError(f"{self.name}: least quality above the greatest")

    def scaled(self, factor: float) -> Codec:
        return dataclasses.replace(self, probability=self.probability * factor)


@dataclass(frozen=True)
class Resize:
    fixed_scale: float = 1.0
    down_up: bool = False
    down_up_probability: float = 1.0
    down_up_range: tuple[float, float] = (0.15, 0.8)
    filters: tuple[str, ...] = ("bicubic",)


@dataclass(frozen=True)
class Noise:
    y_strength: tuple[float, float] = (1, 10)
    uv_strength: tuple[float, float] = (1, 10)
    types: tuple[str, ...] = ("u",)


@dataclass(frozen=True)
class Halo:
    luma_x: tuple[int, int] = (3, 7)
    luma_y: tuple[int, int] = (3, 7)
    amount: tuple[float, float] = (2.0, 5.0)


@dataclass(frozen=True)
class Blur:
    types: tuple[str, ...] = ("gaussian", "box", "motion")
    sigma: tuple[float, float] = (1.0, 5.0)
    steps: tuple[int, int] = (1, 3)
    radius: tuple[float, float] = (1, 10)
    power: tuple[int, int] = (1, 2)
    frames: tuple[int, int] = (2, 5)
    angle: tuple[int, int] = (0, 360)


@dataclass(frozen=True)
class Ghosting:
    ghosts: tuple[int, int] = (1, 2)
    opacity: tuple[float, float] = (0.2, 0.4)
    delay: tuple[int, int] = (1, 2)
    offset_x: tuple[int, int] = (-1, 1)
    offset_y: tuple[int, int] = (-2, 2)
    color_shift: bool = True
    shift: tuple[float, float] = (0.85, 1.15)


@dataclass(frozen=True)
class Interlace:
    field_orders: tuple[str, ...] = ("top", "bottom")
    chroma_only: bool = False


@dataclass(frozen=True)
class ChromaDelay:
    delay_frames: int = 1


@dataclass(frozen=True)
class Tonemap:
    algorithms: tuple[str, ...] = ("hable",)
    desat: tuple[float, float] = (0.5, 0.5)
    target_nits: int = 100
    auto_detect: bool = True


@dataclass(frozen=True)
class Degradation:
    """One entry of the ordered list; ``params`` is of the class registered under ``name``."""

    name: str
    probability: float = 1.0
    enabled: bool = True
    params: object = None


#: Classes of parameters by the name of the degradation.
PARAMS = {"resize": Resize, "noise": Noise, "halo": Halo, "blur": Blur, "ghosting": Ghosting, "interlace": Interlace, "chroma_delay": ChromaDelay, "tonemap": Tonemap}

#: Fixed values of the sample configuration.
SHIPPED_CODECS = (
    Codec("h264", 0.6, (23, 33), ("veryslow",)),
    Codec("h265", 0.0, (0, 0), ("medium", "slow", "veryslow")),
    Codec("vp9", 0.0, (22, 28)),
    Codec("av1", 0.0, (25, 30), (), (2, 8)),
    Codec("mpeg2", 0.4, (6000, 10000)),
)
SHIPPED = (
    Degradation("resize", 1.0, True, Resize(0.5, False, 0.5, (0.75, 1.0), ("bicubic", "bilinear", "area"))),
    Degradation("noise", 1.0, False, Noise(types=("u", "t", "a"))),
    Degradation("halo", 0.2, False, Halo((3, 5), (3, 5), (0, 0.5))),
    Degradation("blur", 0.4, True, Blur(("gaussian",), (0.7, 2), (1, 3), (0.25, 1), (1, 2), (1, 2), (0, 0))),
    Degradation("ghosting", 0.1, False, Ghosting((1, 2), (0.05, 0.15), (1, 2), (-3, 3), (-2, 2), True)),
    Degradation("interlace", 1.0, False, Interlace()),
    Degradation("chroma_delay", 1.0, False, ChromaDelay(1)),
)


@dataclass(frozen=True)
class Settings:
    """All settings of a run."""

    input: str = ""
    chunks_directory: str = "chunks"
    chunk_strategy: str = "duration"
    chunk_duration: float = 10
    frames_per_chunk: int = 300
    min_chunk_duration: float = 1
    scene_threshold: float = 27.0
    max_scenes: int = 0
    sequence_length: int = 10
    time_gap: float | None = 3.0
    frame_skip: int = 0
    extract_full_chunks: bool = False
    use_scene_detection: bool = False
    max_sequences: int | None = None
    edge_threshold: float = 15.0
    variance_threshold: float = 100.0
    min_blank_frames: int = 2
    min_motion: float = -1
    max_motion: float = -1
    motion_threshold: int = 30
    output_directory: str = ""
    logging_directory: str = ""
    post_processing: bool = False
    tiling: bool = True
    motion_detection: bool = True
    tile_width: int = 256
    tile_height: int = 256
    seed: int = 1024
    degradations: tuple[Degradation, ...] = field(default_factory=tuple)
    codecs: tuple[Codec, ...] = SHIPPED_CODECS


STRATEGIES = ("duration", "scene_detection", "frame_count")


#: Path keys of the sample configuration and the settings that hold them; nested ones by section.
PATHS = {"input": "input", "chunks_directory": "chunks_directory", "frame_extraction.output_directory": "output_directory", "logging.directory": "logging_directory"}


def paths(raw: dict) -> dict[str, str]:
    """The path settings of a parsed mapping, with ``.``, ``..`` and doubled separators resolved; other types are left out."""
    found = {}
    for key, name in PATHS.items():
        value: object = raw
        for part in key.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if isinstance(value, str):
            found[name] = os.path.normpath(value) if value else value
    return found


def pair(owner: str, name: str, value: object) -> tuple:
    """A range as a tuple; anything but two elements is an error."""
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        raise ConfigError(f"{owner}: {name} has to be a list of two numbers")
    return tuple(value)


def _is_range(f: dataclasses.Field) -> bool:
    return isinstance(f.default, tuple) and len(f.default) == 2 and all(isinstance(v, (int, float)) for v in f.default)


def degradation(entry: dict) -> Degradation:
    """Checks one entry of the list; unknown names and keys are errors."""
    for key in ("name", "enabled", "probability"):
        if key not in entry:
            raise ConfigError(f"degradation without {key}")
    name, params = entry["name"], dict(entry.get("params") or {})
    if name == "codec":
        return Degradation(name, float(entry["probability"]), bool(entry["enabled"]), params)
    if name not in PARAMS:
        raise ConfigError(f"unknown degradation {name}")
    known = {f.name for f in dataclasses.fields(PARAMS[name])}
    if unknown := params.keys() - known:
        raise ConfigError(f"{name}: unknown parameters {sorted(unknown)}")
    for f in dataclasses.fields(PARAMS[name]):
        if f.name in params and _is_range(f):
            params[f.name] = pair(name, f.name, params[f.name])
    made = PARAMS[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in params.items()})
    return Degradation(name, float(entry["probability"]), bool(entry["enabled"]), made)


def settings(raw: dict, strict: bool = True) -> Settings:
    """Settings from a parsed YAML mapping. ``strict`` asks for an input, a known strategy and an enabled codec."""
    known = {f.name for f in dataclasses.fields(Settings)} - {"degradations", "codecs"}
    listed = [degradation(e) for e in raw.get("degradations", ())]
    coded = [d for d in listed if d.name == "codec"]
    values = {k: v for k, v in raw.items() if k in known} | paths(raw)
    if coded:
        values["codecs"] = tuple(
            Codec(n, float(c["probability"]), pair(n, "quality_range", c["quality_range"]), tuple(c.get("presets", ())), pair(n, "preset_range", c["preset_range"]) if "preset_range" in c else None)
            for n, c in coded[0].params.items()
        )
    made = Settings(**values, degradations=tuple(d for d in listed if d.name != "codec"))
    if strict:
        if not made.input:
            raise ConfigError("no input")
        if made.chunk_strategy not in STRATEGIES:
            raise ConfigError(f"unknown chunk strategy {made.chunk_strategy}")
        if not any(d.enabled for d in coded):
            raise ConfigError("the codec has to be enabled")
    return made


def load(path: str, strict: bool = True, file_required: bool | None = None) -> Settings:
    """Settings from a YAML file; a missing or unreadable file gives the defaults unless ``file_required`` (as strict as the content by default)."""
    import yaml

    try:
        with open(path, encoding="utf-8") as file:
            raw = yaml.safe_load(file) or {}
    except (OSError, yaml.YAMLError):
        if strict if file_required is None else file_required:
            raise
        raw = {}
    return settings(raw, strict)


def overlaid(base: Settings, **given: object) -> Settings:
    """``base`` with the values that are not None."""
    return dataclasses.replace(base, **{k: v for k, v in given.items() if v is not None})


def post_processing(base: Settings, no_tiling: bool = False, no_motion: bool = False, **given: object) -> Settings:
    """Overrides of a post-processing run, which is thereby enabled: output_directory, tile_width, tile_height, seed, min_motion, max_motion, motion_threshold."""
    made = overlaid(base, **given)
    return dataclasses.replace(made, post_processing=True, tiling=made.tiling and not no_tiling, motion_detection=made.motion_detection and not no_motion)
