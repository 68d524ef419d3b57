"""Settings and their validation."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field, replace

from twinlake.functions.digests import parse_algorithm
from twinlake.functions.sizes import parse_size

GIB4 = 4 << 30
#: Folders of virtual file systems.
VIRTUAL = ["/proc", "/sys", "/dev", "/run", "/var/run"]


@dataclass(frozen=True)
class ScanConfig:
    """Which files take part; sizes are bytes, 0 means no bound, depth -1 means any."""

    min_size: int = 0
    max_size: int = GIB4
    empty: bool = False
    hidden: bool = False
    max_depth: int = -1
    exclude: list[str] = field(default_factory=list)
    virtual: bool = False
    one_file_system: bool = False
    min_group: int = 2
    algorithm: str = "sha256"

    def __post_init__(self) -> None:
        if self.min_group < 2:
            raise ValueError("a group has two files at least")
        if self.max_depth < -1:
            raise ValueError("depth is -1 or more")
        if min(self.min_size, self.max_size) < 0 or 0 < self.max_size < self.min_size:
            raise ValueError("bounds of sizes are out of order")
        parse_algorithm(self.algorithm)

    @classmethod
    def of(cls, min_size: str = "0", max_size: str | None = None, all_sizes: bool = False, current: bool = False, **rest) -> ScanConfig:
        """From texts as users write them."""
        if all_sizes and max_size is not None:
            raise ValueError("all sizes and a largest size exclude each other")
        top = 0 if all_sizes else GIB4 if max_size is None else parse_size(max_size)
        if current:
            rest["max_depth"] = 0
        return cls(min_size=parse_size(min_size), max_size=top, **rest)


@dataclass(frozen=True)
class FuzzyConfig:
    """Near-content settings; a threshold or ``read_limit`` of 0 means the default, ``max_candidates`` -1
    no cap, ``read_limit`` -1 the whole content."""

    threshold: int = 75
    same_extension: bool = False
    max_candidates: int = 10_000
    min_size: int = 4000
    max_ratio: float = 2.0
    min_group: int = 2
    read_limit: int = 256 * 1024

    def __post_init__(self) -> None:
        put = lambda k, v: object.__setattr__(self, k, v)
        put("threshold", min(100, max(0, self.threshold)) or 75)
        put("min_group", max(2, self.min_group))
        put("max_candidates", self.max_candidates or 10_000)
        put("max_ratio", 2.0 if self.max_ratio < 1 else self.max_ratio)
        put("read_limit", self.read_limit or 256 * 1024)


@dataclass(frozen=True)
class RestoreConfig:
    """What a restore may overwrite, checks and gives back; a dry run changes nothing even if confirmed."""

    overwrite: bool = False
    verify_hash: bool = True
    restore_mode: bool = True
    restore_mtime: bool = True
    dry_run: bool = False


def looks_at_hidden(hidden: bool = False, name: str = "", single_file: str = "") -> bool:
    """Hidden files take part if asked for, or if the name or the single file that is looked for is one."""
    return hidden or name.startswith(".") or posixpath.basename(single_file).startswith(".")


def check_modes(name_only: bool = False, file_name: bool = False, single_file: bool = False, fuzzy: bool = False, restore: bool = False, backup: bool = False, keep: bool = False, link: bool = False, reflink: bool = False) -> None:
    """Which modes exclude each other. A single file goes with name groups: its name is then what is looked for."""
    names = name_only or file_name
    clashes = [
        (file_name and single_file, "a file name and a single file exclude each other"),
        (names and backup, "name groups cannot be backed up"),
        (link and reflink, "links and clones exclude each other"),
        (fuzzy and (names or single_file or backup or restore or keep or link or reflink), "near-content groups are only reported"),
        (restore and (names or single_file or fuzzy or backup or keep or link or reflink), "a restore stands alone"),
    ]
    for bad, why in clashes:
        if bad:
            raise ValueError(why)


@dataclass(frozen=True)
class RunConfig:
    """A whole run: which files, which kind of groups, and what is to become of them. ``fuzzy`` asks for near-content
    groups, ``name_only`` or ``file_name`` for name groups (of that name), ``single_file`` for what has that file's
    content, or its name if name groups are asked for; else all content groups. ``keep`` files of each group stay
    and the rest are deleted, linked or cloned by ``action``; 0 makes no plan. ``keep_below_minimum``: a plan also
    reduces groups that are too small to be shown, as long as they have more than ``keep`` files."""

    scan: ScanConfig = field(default_factory=ScanConfig)
    fuzzy: FuzzyConfig | None = None
    name_only: bool = False
    file_name: str = ""
    single_file: str = ""
    keep: int = 0
    action: str = "delete"
    backup: bool = False
    keep_below_minimum: bool = False

    def __post_init__(self) -> None:
        if self.keep < 0 or self.action not in ("delete", "link", "reflink"):
            raise ValueError("how many files to keep, or what to do with the others, is not known")
        check_modes(self.name_only, bool(self.file_name), bool(self.single_file), self.fuzzy is not None, False, self.backup, self.keep > 0, self.action == "link", self.action == "reflink")
        if self.mode == "name" and (self.file_name or self.single_file) and self.name in ("", "."):
            raise ValueError("a folder has no file name")

    @property
    def mode(self) -> str:
        return "fuzzy" if self.fuzzy else "name" if self.name_only or self.file_name else "single" if self.single_file else "content"

    @property
    def name(self) -> str:
        """The base name that is looked for, if any."""
        return posixpath.basename((self.file_name or self.single_file).rstrip("/")) if self.mode == "name" else ""

    @property
    def files(self) -> ScanConfig:
        """What to scan: hidden files too, if the name or the single file that is looked for is one."""
        return replace(self.scan, hidden=looks_at_hidden(self.scan.hidden, self.name, self.single_file))
