"""Typed settings from a mapping of strings (environment variables, or a session's configuration)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Prefix of the settings in a session's configuration.
PREFIX = "spark.vocaris."


def _flag(value: str | None, default: bool) -> bool:
    return default if value is None or not value.strip() else value.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    service: str = "diarization"
    queue: str = "diarization"
    store: str | None = None  # where voiceprints live; None switches identification off
    legacy_collection: str | None = None  # the one collection of requests without collections
    min_similarity: str | None = None  # kept as text: empty counts as not given
    identify_twice: bool = True  # whether several tags of a recording may be one speaker
    cache_results: bool = False
    window_step: float = 0.1
    least_enrollment: int = 3
    most_enrollment: int = 180

    @classmethod
    def of(cls, values: Mapping[str, str]) -> Settings:
        """Values by field name, missing and empty ones at their defaults; a queue without a name is
        the service's. A bad number is a ValueError that names its field."""
        given = {k: v.strip() for k, v in values.items() if v is not None and v.strip()}

        def number(name: str, kind: type, default: float) -> float:
            try:
                return kind(given.get(name, default))
            except ValueError:
                raise ValueError(f"{name} is no number: {given[name]!r}") from None

        step = number("window_step", float, cls.window_step)
        if not 0 < step <= 1:
            raise ValueError(f"window_step must be above 0 and at most 1, not {step}")
        service = given.get("service", cls.service)
        return cls(
            service, given.get("queue", service), given.get("store"), given.get("legacy_collection"), given.get("min_similarity"),
            _flag(given.get("identify_twice"), True), _flag(given.get("cache_results"), False), step,
            number("least_enrollment", int, cls.least_enrollment), number("most_enrollment", int, cls.most_enrollment),
        )

    @classmethod
    def of_session(cls, spark: SparkSession) -> Settings:
        """Settings ``spark.vocaris.<field>`` of a session."""
        return cls.of({name: v for name in cls.__dataclass_fields__ if (v := spark.conf.get(PREFIX + name, None)) is not None})

    @property
    def can_identify(self) -> bool:
        return self.store is not None

    def require_store(self) -> str:
        if self.store is None:
            raise RuntimeError("speaker identification is off: no store of voiceprints is configured")
        return self.store

    def require_legacy_collection(self) -> str:
        if self.legacy_collection is None:
            raise RuntimeError("a request without collections needs legacy_collection")
        return self.legacy_collection

    def step_samples(self, window_samples: int) -> int:
        """The step between windows: a share of the window, at least one sample."""
        return max(1, int(self.window_step * window_samples))
