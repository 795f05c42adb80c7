"""Settings of a run, from an INI file.

Each section has keys of its own, with several spellings where files differ; a key or section that nothing reads is an
error, so that a misspelt setting is not passed over. Keys that size thread and process pools are known but have no
effect: Spark has its own.
"""

from __future__ import annotations

import ast
import configparser
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting that cannot be read."""


@dataclass(frozen=True)
class Config:
    """Defaults are those of the operators."""

    input_dir: str = "."
    output_dir: str = "out"
    feature_types: tuple[str, ...] = ("packet_length", "inter_arrival_time", "direction", "up_down_rate")
    num_phases: tuple[int, ...] = (2,)
    timeout_sec: float = 600.0
    max_flow_length: int = 1000
    min_flow_length: int = 3
    weights: dict[str, float] = field(default_factory=dict)
    lambda_dict: dict[str, float] = field(default_factory=dict)
    regularization_lambda: float = 1e-3
    meter_timeout_sec: float = 120.0
    concat_timeout_sec: float = 600.0
    concat_mask: tuple[str, ...] = ("Flow ID", "Label")
    label_mask: tuple[str, ...] = ()
    time_format: str = "dd/MM/yyyy hh:mm:ss a"
    rules_path: str = ""
    rule_shift_sec: float = 0.0
    rule_zone: str = ""


#: Key of a section to setting; None: known, without effect here.
KEYS: dict[str, dict[str, str | None]] = {
    "pss": {
        "allowed_feature_names": "feature_types", "feature_types": "feature_types", "num_phases": "num_phases", "max_flow_length": "max_flow_length", "min_flow_length": "min_flow_length",
        "timeout_sec": "timeout_sec", "lambda_dict": "lambda_dict", "feature_weights": "weights", "weights": "weights", "regularization_lambda": "regularization_lambda",
        "short_threshold": None, "long_threshold": None, "batch_size": None,
    },
    "cfm": {"max_workers": None, "timeout_min": None, "timeout_sec": "meter_timeout_sec"},
    "concat": {"max_workers": None, "mask_features": "concat_mask", "mask": "concat_mask", "timeout_sec": "concat_timeout_sec"},
    "label": {
        "max_workers": None, "mask_features": "label_mask", "mask": "label_mask", "rules_file": "rules_path", "rules_path": "rules_path", "time_zone_adjustment": "rule_zone", "time_zone": "rule_zone",
        "rule_shift_sec": "rule_shift_sec", "time_format": "time_format",
    },
    "pipeline": {"pcap_workers": None, "input_dir": "input_dir", "output_dir": "output_dir"},
}

#: Codes of C's time formats and the patterns of the same fields.
CODES = {"d": "dd", "m": "MM", "Y": "yyyy", "y": "yy", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "xx", "Z": "zzz", "%": "%"}


def time_pattern(text: str) -> str:
    """A pattern as Spark reads it; ``%d/%m/%Y`` and the like are translated, ``%%`` standing for ``%`` or not."""
    text = text.replace("%%", "%")
    if "%" not in text:
        return text
    out, at = "", 0
    while at < len(text):
        c = text[at]
        if c == "%":
            code = text[at + 1 : at + 2]
            if code not in CODES:
                raise ConfigError(f"time format: unknown code %{code}")
            out, at = out + CODES[code], at + 2
        else:
            out, at = out + (f"'{c}'" if c.isalpha() else c), at + 1
    return out


def _value(name: str, text: str, like: Any) -> Any:
    text = text.split(";")[0].strip()
    try:
        if isinstance(like, dict):
            return {str(k): float(v) for k, v in ast.literal_eval(text).items()} if text else {}
        if isinstance(like, tuple):
            parts = [p.strip().strip("'\"") for p in text.strip("[]()").split(",") if p.strip()]
            return tuple(int(p) for p in parts) if name == "num_phases" else tuple(parts)
        return type(like)(text)
    except (ValueError, SyntaxError, AttributeError) as e:
        raise ConfigError(f"{name}: cannot read {text!r}") from e


def _zone(text: str, own: str) -> str:
    """A zone's name; yes stands for the session's own, no for none."""
    text = text.split(";")[0].strip()
    return {"1": own, "true": own, "yes": own, "on": own, "0": "", "false": "", "no": "", "off": "", "": ""}.get(text.lower(), text)


def load(path: str, zone: str = "UTC") -> Config:
    """Reads an INI file; comments after ``;`` are cut off.

    Sections may be left out. A relative rules path is relative to the file. ``zone`` is the session's time zone, to which
    rule times are moved from UTC where the file asks for it without naming one.
    """
    parser = configparser.RawConfigParser()
    if not parser.read(path, encoding="utf-8"):
        raise FileNotFoundError(path)
    like = {f.name: getattr(Config(), f.name) for f in fields(Config)}
    found: dict[str, Any] = {}
    for section in parser.sections():
        if section not in KEYS:
            raise ConfigError(f"unknown section: {section}")
        for key, text in parser.items(section):
            if key not in KEYS[section]:
                raise ConfigError(f"unknown key: [{section}] {key}")
            name = KEYS[section][key]
            if name == "rule_zone":
                found[name] = _zone(text, zone) or found.get(name, "")
            elif name == "time_format":
                found[name] = time_pattern(text.split(";")[0].strip())
            elif name:
                found[name] = _value(name, text, like[name])
    if rules := found.get("rules_path"):
        found["rules_path"] = str((Path(path).parent / rules).resolve())
    return Config(**found)
