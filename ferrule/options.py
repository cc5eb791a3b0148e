"""Options of a run, as flags and an argument parser."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from enum import IntEnum, IntFlag


class Severity(IntEnum):
    """How bad an issue is; the number is also a run's exit code."""

    NONE = 0
    NOISE = 1
    TRIVIA = 2
    ADVISORY = 3
    WARNING = 4
    ERROR = 5
    FATAL = 6


class Scope(IntEnum):
    """The least severity that a report shows."""

    DETAIL = 1
    VERBOSE = 2
    LUCID = 3
    TERSE = 4
    QUIET = 5


class Tag(IntFlag):
    """What an issue is about; two of the bits decide escalation in strict runs."""

    NONE = 0
    HAS_ID3V1 = 1
    HAS_ID3V24 = 2
    MP3_HAS_APE = 4
    SUBSTANDARD = 8
    OVERSTANDARD = 0x10
    BAD_TAG = 0x20
    STRICT_WARN = 0x100
    STRICT_ERR = 0x200
    SUCCESS = 0x1000000
    FAILURE = 0x2000000


class Hashes(IntFlag):
    """Which digests and checks a run computes."""

    NONE = 0
    INTRINSIC = 1
    FILE_MD5 = 2
    FILE_SHA1 = 4
    FILE_SHA256 = 8
    MEDIA_SHA1 = 0x10
    META_SHA1 = 0x20
    PCM_MD5 = 0x40
    PCM_CRC32 = 0x80


class Validations(IntFlag):
    """Which entries of lists are followed."""

    NONE = 0
    EXISTS = 1
    MD5 = 2
    SHA1 = 4
    SHA256 = 8


ALL_VALIDATIONS = Validations.EXISTS | Validations.MD5 | Validations.SHA1 | Validations.SHA256


@dataclass
class Options:
    """Everything that a run can be told."""

    root: str = "."
    scope: Scope = Scope.VERBOSE
    hashes: Hashes = Hashes.INTRINSIC
    validations: Validations = ALL_VALIDATIONS
    warn: Tag = Tag.NONE
    err: Tag = Tag.NONE
    repair: bool = False
    rip: bool = True
    glob: str | None = None
    exclude: list[str] = field(default_factory=list)
    out: str | None = None

    @property
    def strict(self) -> bool:
        return bool(self.warn & Tag.STRICT_WARN) and bool(self.err & Tag.STRICT_ERR)


def _member(kind: type, text: str):
    """A member, or the union of a comma list of members, by names in any case."""
    names = {m.name.replace("_", "").lower(): m for m in kind}
    out = None
    for part in text.replace("_", "").lower().split(","):
        if part not in names:
            raise argparse.ArgumentTypeError(f"{part!r} is none of {', '.join(names)}")
        out = names[part] if out is None else out | names[part]
    return out


def parse(arguments: list[str]) -> Options:
    """Options of a command line."""
    p = argparse.ArgumentParser(prog="ferrule", description="Diagnose the files under a folder.")
    p.add_argument("root")
    p.add_argument("--scope", type=lambda s: _member(Scope, s), default=Scope.VERBOSE)
    p.add_argument("--hash", dest="hashes", type=lambda s: _member(Hashes, s), default=Hashes.INTRINSIC)
    p.add_argument("--verify", dest="validations", type=lambda s: _member(Validations, s), default=ALL_VALIDATIONS)
    p.add_argument("--warn", type=lambda s: _member(Tag, s), default=Tag.NONE)
    p.add_argument("--err", type=lambda s: _member(Tag, s), default=Tag.NONE)
    p.add_argument("--strict", action="store_true")
    p.add_argument("--repair", action="store_true")
    p.add_argument("--no-rip", dest="rip", action="store_false")
    p.add_argument("--glob")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--out")
    a = vars(p.parse_args(arguments))
    strict = a.pop("strict")
    options = Options(**a)
    if strict:
        options.warn |= Tag.STRICT_WARN
        options.err |= Tag.STRICT_ERR
    return options
