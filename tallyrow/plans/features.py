"""Feature plan: which columns of an impression table play which role.

The plan lives on the driver and holds a few entries per column, never data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyrow.plans.fixed import DEFAULT_SEQ_LEN

USER_INT = "user_int"
ITEM_INT = "item_int"
USER_DENSE = "user_dense"

# Fixed formats: column names that carry the role.
_ROLE_FORMATS = {
    USER_INT: re.compile(r"user_int_feats_(\d+)"),
    ITEM_INT: re.compile(r"item_int_feats_(\d+)"),
    USER_DENSE: re.compile(r"user_dense_feats_(\d+)"),
}
_SEQUENCE_FORMAT = re.compile(r"domain_([a-z]+)_seq_(\d+)")


@dataclass(frozen=True)
class IntFeature:
    section: str
    fid: int
    vocab: int = 0
    dim: int = 1

    @property
    def column(self) -> str:
        return f"{self.section}_feats_{self.fid}"


@dataclass(frozen=True)
class DenseFeature:
    fid: int
    dim: int = 1

    @property
    def column(self) -> str:
        return f"{USER_DENSE}_feats_{self.fid}"


@dataclass(frozen=True)
class SequenceDomain:
    """Parallel list columns of one behaviour domain; ``vocabs`` maps fid to vocab."""

    letter: str
    vocabs: dict[int, int]
    ts_fid: int | None = None
    max_len: int = DEFAULT_SEQ_LEN

    @property
    def name(self) -> str:
        return f"seq_{self.letter}"

    def column(self, fid: int) -> str:
        return f"domain_{self.letter}_seq_{fid}"

    @property
    def ts_column(self) -> str | None:
        return None if self.ts_fid is None else self.column(self.ts_fid)

    @property
    def side_fids(self) -> list[int]:
        return sorted(fid for fid in self.vocabs if fid != self.ts_fid)


@dataclass(frozen=True)
class FeaturePlan:
    user_int: tuple[IntFeature, ...] = ()
    item_int: tuple[IntFeature, ...] = ()
    user_dense: tuple[DenseFeature, ...] = ()
    domains: tuple[SequenceDomain, ...] = field(default_factory=tuple)

    def int_features(self) -> tuple[IntFeature, ...]:
        return self.user_int + self.item_int

    def to_dict(self) -> dict:
        """The portable catalog layout: lists of [fid, vocab, dim] and a ``seq`` map."""
        return {
            USER_INT: [[f.fid, f.vocab, f.dim] for f in self.user_int],
            ITEM_INT: [[f.fid, f.vocab, f.dim] for f in self.item_int],
            USER_DENSE: [[f.fid, f.dim] for f in self.user_dense],
            "seq": {
                d.name: {
                    "prefix": f"domain_{d.letter}_seq",
                    "ts_fid": d.ts_fid,
                    "features": [[fid, d.vocabs[fid]] for fid in sorted(d.vocabs)],
                }
                for d in self.domains
            },
        }

    @classmethod
    def from_dict(cls, raw: dict, max_lens: dict[str, int] | None = None) -> "FeaturePlan":
        lens = max_lens or {}
        domains = []
        for name, entry in sorted(raw.get("seq", {}).items()):
            letter = name.removeprefix("seq_")
            domains.append(
                SequenceDomain(
                    letter,
                    {int(fid): int(vocab) for fid, vocab in entry["features"]},
                    entry.get("ts_fid"),
                    lens.get(name, DEFAULT_SEQ_LEN),
                )
            )
        return cls(
            tuple(IntFeature(USER_INT, *map(int, e)) for e in raw.get(USER_INT, [])),
            tuple(IntFeature(ITEM_INT, *map(int, e)) for e in raw.get(ITEM_INT, [])),
            tuple(DenseFeature(*map(int, e)) for e in raw.get(USER_DENSE, [])),
            tuple(domains),
        )


def is_list(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


@dataclass(frozen=True)
class ColumnRole:
    column: str
    section: str
    fid: int
    is_list: bool
    letter: str | None = None


def column_roles(schema: T.StructType) -> list[ColumnRole]:
    """Roles of all feature columns, read from names and types alone."""
    roles = []
    for entry in schema.fields:
        is_list = isinstance(entry.dataType, T.ArrayType)
        sequence = _SEQUENCE_FORMAT.fullmatch(entry.name)
        if sequence:
            letter, fid = sequence.groups()
            roles.append(ColumnRole(entry.name, f"seq_{letter}", int(fid), is_list, letter))
            continue
        for section, name_format in _ROLE_FORMATS.items():
            match = name_format.fullmatch(entry.name)
            if match:
                roles.append(ColumnRole(entry.name, section, int(match.group(1)), is_list))
    return sorted(roles, key=lambda r: (r.section, r.fid))
