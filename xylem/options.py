"""Options of the strict scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession


#: Names that the option profile may have; ``records.register_profile`` adds to them.
PROFILE_NAMES = ["auto", "none", "soap_healthcare", "payments"]


@dataclass(frozen=True)
class XmlOptions:
    """utf8: strict or none; max_depth: open elements; capacity: bytes of a document; profile: auto, none, soap_healthcare
    or payments; region: header or anywhere, where WS-Addressing fields may stand; mode: PERMISSIVE, DROPMALFORMED or
    FAILFAST, as for Spark's readers."""

    utf8: str = "strict"
    max_depth: int = 1024
    capacity: int = 34 << 20
    profile: str = "auto"
    region: str = "header"
    mode: str = "PERMISSIVE"

    def __post_init__(self) -> None:
        alias = {"on": "strict", "true": "strict", "off": "none", "false": "none"}
        object.__setattr__(self, "utf8", alias.get(self.utf8.lower(), self.utf8.lower()))
        object.__setattr__(self, "mode", self.mode.upper())
        object.__setattr__(self, "profile", self.profile.lower())
        for name, allowed in (("utf8", ("strict", "none")), ("profile", PROFILE_NAMES), ("region", ("header", "anywhere")), ("mode", ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.max_depth < 1 or self.capacity < 1:
            raise ValueError("max_depth and capacity must be positive")

    @classmethod
    def from_session(cls, spark: SparkSession, **given) -> XmlOptions:
        """Options set as spark.conf keys ``xylem.<name>``; given ones come first."""
        kinds = {"max_depth": int, "capacity": int}
        found = {n: kinds.get(n, str)(v) for n in cls.__dataclass_fields__ if (v := spark.conf.get(f"xylem.{n}", None)) is not None}
        return cls(**(found | given))

    @classmethod
    def of(cls, df: DataFrame) -> XmlOptions:
        """What the table's session sets; the defaults where it sets nothing."""
        return cls.from_session(df.sparkSession)

    def with_(self, **changes) -> XmlOptions:
        return replace(self, **changes)

    def describe(self) -> dict[str, str]:
        return {n: str(getattr(self, n)) for n in self.__dataclass_fields__}
