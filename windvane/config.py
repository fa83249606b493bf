"""Fixed vocabulary of the engine: farms, channels, states, experiments, models."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Farm -> feature -> raw channel (or channels, averaged), and units.
# ---------------------------------------------------------------------------
FARM_CHANNELS: dict[str, dict[str, tuple[str, ...]]] = {
    "A": {
        "amb_temp": ("sensor_0_avg",),
        "wind_speed": ("wind_speed_3_avg",),
        "pitch_angle": ("sensor_5_avg",),
        "active_power": ("sensor_44", "sensor_45", "sensor_46"),
        "gen_speed": ("sensor_18_avg",),
        "gearbox_oil_temp": ("sensor_12_avg",),
        "transformer_temp": ("sensor_38_avg", "sensor_39_avg", "sensor_40_avg"),
        "nacelle_temp": ("sensor_43_avg",),
        "hub_temp": ("sensor_6_avg",),
        "yaw_error": ("sensor_2_avg",),
        "vibration_raw": ("sensor_18_std",),
        "hydraulic_temp": ("sensor_41_avg",),
        "generator_temp": ("sensor_13_avg", "sensor_14_avg"),
    },
    "B": {
        "amb_temp": ("sensor_8_avg",),
        "wind_speed": ("wind_speed_61_avg",),
        "pitch_angle": ("sensor_10_avg",),
        "active_power": ("power_62_avg",),
        "gen_speed": ("sensor_19_avg",),
        "gearbox_oil_temp": ("sensor_39_avg",),
        "transformer_temp": ("sensor_41_avg", "sensor_43_avg", "sensor_45_avg"),
        "nacelle_temp": ("sensor_31_avg",),
        "hub_temp": ("sensor_22_avg",),
        "yaw_error": ("sensor_4_avg", "sensor_21_avg"),
        "vibration_raw": ("sensor_54_avg", "sensor_55_avg", "sensor_56_avg"),
        "hydraulic_temp": (),
        "generator_temp": ("sensor_32_avg", "sensor_33_avg"),
    },
    "C": {
        "amb_temp": ("sensor_7_avg",),
        "wind_speed": ("wind_speed_237_avg",),
        "pitch_angle": ("sensor_76_avg",),
        "active_power": ("power_6_avg",),
        "gen_speed": ("sensor_8_avg",),
        "gearbox_oil_temp": ("sensor_186_avg", "sensor_187_avg"),
        "transformer_temp": ("sensor_191_avg", "sensor_192_avg"),
        "nacelle_temp": ("sensor_41_avg",),
        "hub_temp": ("sensor_65_avg",),
        "yaw_error": ("sensor_124_avg",),
        "vibration_raw": ("sensor_90_avg", "sensor_91_avg", "sensor_92_avg", "sensor_93_avg"),
        "hydraulic_temp": ("sensor_178_avg", "sensor_179_avg"),
        "generator_temp": (
            "sensor_199_avg", "sensor_200_avg", "sensor_201_avg",
            "sensor_202_avg", "sensor_203_avg", "sensor_204_avg",
        ),
    },
}

FARM_UNITS: dict[str, dict[str, str]] = {
    "A": {"power": "Wh", "speed": "RPM"},
    "B": {"power": "kW", "speed": "RPM"},
    "C": {"power": "kW", "speed": "rad/s"},
}

# Output schema column groups.
STANDARD_FEATURES = (
    "amb_temp", "wind_speed", "pitch_angle", "active_power", "gen_speed",
    "gearbox_oil_temp", "transformer_temp", "nacelle_temp", "hub_temp",
    "yaw_error", "vibration_raw", "hydraulic_temp", "generator_temp",
)
DERIVED_FEATURES = (
    "temp_delta_gearbox", "temp_trend_24h", "rpm_volatility",
    "temp_divergence", "power_efficiency", "vibration_magnitude",
)
LAG_SIGNALS = ("gearbox_oil_temp", "generator_temp", "active_power", "yaw_error")
LAG_WINDOWS = (6, 24)
TREND_ROWS = 144
RPM_ROWS = 36
TEMPORAL_FEATURES = tuple(
    f"{signal}_{kind}_{rows}"
    for signal in LAG_SIGNALS
    for rows in LAG_WINDOWS
    for kind in ("delta", "volatility")
)
IDENTITY_COLUMNS = ("time_stamp", "farm_id", "asset_id")
LABEL_COLUMNS = (
    "event_id", "event_label", "event_start", "event_end",
    "state_label", "state_name", "is_excluded_buffer", "target",
)

WH_TO_KW = 0.006

# Operating states by code.
STATE_NAMES = ("normal", "pre_48_72h", "pre_24_48h", "pre_0_24h", "event_occurring", "excluded_buffer")
STATE_CODES = {name: code for code, name in enumerate(STATE_NAMES)}
BUFFER_STATE = "excluded_buffer"

# Columns that must never be model inputs.
FORBIDDEN_FEATURES = frozenset({
    "asset_id", "turbine_id", "farm_id", "wind_farm", "event_id", "event_type", "event_code",
    "time_stamp", "timestamp", "date", "datetime",
    "target", "label", "state_label", "state_name", "binary_target",
    "is_excluded_buffer", "exclude_from_training",
    "split", "fold", "cv_fold", "set_type",
    "event_label", "event_start", "event_end", "row_id",
})
FEATURE_SUBSETS: dict[str, dict[str, tuple[str, ...]]] = {"all": {}}

# Experiments and model settings.
EXPERIMENTS: dict[str, dict] = {
    "pre_24h": {"positive_states": ("pre_0_24h", "event_occurring")},
    "pre_48h": {"positive_states": ("pre_24_48h", "pre_0_24h", "event_occurring")},
    "pre_72h": {"positive_states": ("pre_48_72h", "pre_24_48h", "pre_0_24h", "event_occurring")},
}
EXPERIMENT_MODELS = ("logistic", "rf", "gbt")
MODEL_ALIASES = {"xgboost": "gbt"}
MODELS: dict[str, dict] = {
    "logistic": {"C": 1.0, "max_iter": 1000},
    "rf": {"n_estimators": 200, "max_depth": 10, "min_samples_leaf": 5},
    "gbt": {
        "n_estimators": 300, "max_depth": 6, "learning_rate": 0.05,
        "subsample": 0.8, "colsample": 0.8,
    },
}
MODEL_DEFAULTS: dict[str, dict] = {
    "logistic": {"C": 1.0, "max_iter": 1000},
    "rf": {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 1},
    "gbt": {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0, "colsample": 1.0},
}

# The hand-picked part of the threshold grid.
COMMON_THRESHOLDS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
TUNABLE_METRICS = ("f1", "precision", "recall", "balanced_accuracy", "specificity")
TIMELINE_SIGNALS = ("vibration_raw", "nacelle_temp", "temp_delta_gearbox")


@dataclass(frozen=True)
class FarmMap:
    """Channel mapping and units per farm; pass your own to harmonize other fleets."""

    channels: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=lambda: FARM_CHANNELS)
    units: dict[str, dict[str, str]] = field(default_factory=lambda: FARM_UNITS)
    features: tuple[str, ...] = STANDARD_FEATURES

    @classmethod
    def from_dict(cls, config: dict) -> "FarmMap":
        """Build from a parsed ``{farms: {id: {sensors, units}}, standard_features}`` config."""
        channels, units = {}, {}
        for farm, spec in config["farms"].items():
            channels[farm] = {
                feature: () if ref is None else (ref,) if isinstance(ref, str) else tuple(ref)
                for feature, ref in spec["sensors"].items()
            }
            units[farm] = dict(spec["units"])
        return cls(channels, units, tuple(config["standard_features"]))

    @classmethod
    def from_yaml(cls, path: str) -> "FarmMap":
        try:
            import yaml
        except ImportError as exc:
            raise ImportError("reading a YAML feature map needs PyYAML; use FarmMap.from_dict") from exc
        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle))

    def required_channels(self, farm: str) -> list[str]:
        wanted = ["time_stamp", "asset_id"]
        for refs in self.channels[farm].values():
            wanted.extend(ref for ref in refs if ref not in wanted)
        return wanted


@dataclass(frozen=True)
class Experiment:
    name: str
    positive_states: tuple[str, ...]
    models: tuple[str, ...] = EXPERIMENT_MODELS
    optimize_for: str = "f1"
    split_method: str = "event_chronological"
    buffer_as_negative: bool = False


def experiment(name: str, **overrides) -> Experiment:
    if name not in EXPERIMENTS:
        raise ValueError(f"unknown experiment {name!r}; known: {sorted(EXPERIMENTS)}")
    return Experiment(name, **{**EXPERIMENTS[name], **overrides})


def model_name(name: str) -> str:
    return MODEL_ALIASES.get(name, name)


def model_params(name: str, **overrides) -> dict:
    name = model_name(name)
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {sorted(MODELS)}")
    return {**MODELS[name], **overrides}


def state_code(state: str | int) -> int:
    """Resolve a state name or code, rejecting anything outside the vocabulary."""
    if isinstance(state, int) and not isinstance(state, bool):
        if 0 <= state < len(STATE_NAMES):
            return state
        raise ValueError(f"unknown state code {state}")
    if state in STATE_CODES:
        return STATE_CODES[state]
    raise ValueError(f"unknown state name {state!r}")
