"""Versioned manifests: the list of stripes that make up a table at one version.

A version is one JSON file that is published once and never changes, so a reader that holds a version has a
snapshot, and a manifest may be cached by its version without any invalidation. It doesn't hold the stripes itself
but names parts: files of PART_STRIPES stripes or fewer, with the bounds of all of them together. A commit writes the
parts that it changes and the list, so its cost follows the change; a scan skips whole parts by their bounds and
reads the others alone.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from .bounds import combined
from .errors import CommitConflict, NotAStripeTable
from .storage import Store
from .types import stats_kind

#: Attempts of a commit before it gives up.
RETRIES = 20
#: Stripes of a part at most, and parts that a handle keeps in memory.
PART_STRIPES, PARTS_HELD = 1000, 64
FOLDER = "_manifest"


@dataclass(frozen=True)
class Stripe:
    id: int
    file: str
    rows: int
    size: int
    codec: str
    deleted: int = 0
    #: column: [min, max, nulls, has_nan], min and max in JSON form or null
    stats: dict = field(default_factory=dict)
    #: of a stripe that shares its file: its first row there, rows of each stripe there but the last, rows of the whole file
    first: int = 0
    each: int = 0
    held: int = 0

    @property
    def name(self) -> str:
        return self.file.rpartition("/")[2]

    @property
    def key(self) -> tuple[str, int]:
        return self.name, self.first

    @property
    def place(self) -> str:
        return f"{self.file}#{self.first}" if self.each else self.file


@dataclass(frozen=True)
class Part:
    """A file of stripes that never changes; counts and bounds over all of them."""

    file: str
    count: int
    rows: int
    size: int
    stats: dict


@dataclass(frozen=True)
class Deletes:
    """A folder of deleted rows (file, row) and the ids of the stripes that they are in."""

    folder: str
    ids: tuple[int, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: T.StructType
    parts: tuple[Part, ...] = ()
    next_id: int = 1
    #: deleted rows of the stripes that have any
    dirty: dict = field(default_factory=dict)
    deletes: tuple[Deletes, ...] = ()
    options: dict = field(default_factory=dict)
    #: reads a part's stripes
    load: Callable[[Part], list[Stripe]] | None = field(default=None, compare=False, repr=False)

    def of_part(self, p: Part) -> list[Stripe]:
        return [replace(s, deleted=self.dirty.get(s.id, 0)) for s in self.load(p)]

    def each(self, want: Callable[[Part], bool] = lambda p: True) -> Iterator[Stripe]:
        for p in self.parts:
            if want(p):
                yield from self.of_part(p)

    @property
    def stripes(self) -> list[Stripe]:
        return list(self.each())

    @property
    def count(self) -> int:
        return sum(p.count for p in self.parts)

    @property
    def live_rows(self) -> int:
        return sum(p.rows for p in self.parts) - sum(self.dirty.values())

    @property
    def bytes(self) -> int:
        return sum(p.size for p in self.parts)

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: k for f in self.schema if (k := stats_kind(f.dataType))}

    @staticmethod
    def of(schema: T.StructType, stripes: Iterable[Stripe], **how) -> Manifest:
        """A manifest in memory alone."""
        stripes = list(stripes)
        m = Manifest(1, schema, dirty={s.id: s.deleted for s in stripes if s.deleted}, **how)
        part = Part("", len(stripes), sum(s.rows for s in stripes), sum(s.size for s in stripes), combined(((s.rows, s.stats) for s in stripes), m.kinds))
        return replace(m, parts=(part,), load=lambda p: stripes)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "schema": self.schema.jsonValue(), "parts": [asdict(p) for p in self.parts], "next_id": self.next_id, "dirty": list(self.dirty.items()), "deletes": [asdict(d) for d in self.deletes], "options": self.options})

    @staticmethod
    def from_json(text: str, load: Callable[[Part], list[Stripe]]) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], T.StructType.fromJson(d["schema"]), tuple(Part(**p) for p in d["parts"]), d["next_id"], {int(k): n for k, n in d["dirty"]}, tuple(Deletes(x["folder"], tuple(x["ids"])) for x in d["deletes"]), d["options"], load)


class Log:
    """The versions of one table."""

    def __init__(self, store: Store, counters: dict[str, int]):
        self.store, self.counters = store, counters
        self.cached: dict[int, Manifest] = {}
        self.parts: OrderedDict[str, list[Stripe]] = OrderedDict()

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self.store.names(FOLDER) if n.startswith("v") and n.endswith(".json"))

    def load(self, version: int | None = None) -> Manifest:
        if version is None:
            found = self.versions()
            if not found:
                raise NotAStripeTable(f"{self.store.root} is not a stripe table")
            version = found[-1]
        if version in self.cached:
            self.counters["metadata_hits"] += 1
        else:
            self.counters["metadata_misses"] += 1
            name = f"{FOLDER}/v{version:020d}.json"
            if not self.store.exists(name):
                raise NotAStripeTable(f"{self.store.root} has no version {version}")
            self.cached[version] = Manifest.from_json(self.store.read(name), self.stripes_of)
        return self.cached[version]

    # -- parts ---------------------------------------------------------------------------------------------

    def stripes_of(self, p: Part) -> list[Stripe]:
        if p.file in self.parts:
            self.counters["stats_hits"] += 1
            self.parts.move_to_end(p.file)
        else:
            self.counters["stats_misses"] += 1
            self._hold(p.file, [Stripe(**json.loads(line)) for line in self.store.read(p.file).splitlines()])
        return self.parts[p.file]

    def _hold(self, file: str, stripes: list[Stripe]) -> None:
        self.parts[file] = stripes
        while len(self.parts) > PARTS_HELD:
            self.parts.popitem(last=False)

    def _part(self, stripes: list[Stripe], kinds: dict[str, str]) -> Part:
        file = f"{FOLDER}/part-{uuid.uuid4().hex}.jsonl"
        clean = [replace(s, deleted=0) for s in stripes]
        self.store.mkdirs(FOLDER)
        self.store.write(file, "\n".join(json.dumps(asdict(s)) for s in clean))
        self._hold(file, clean)
        return Part(file, len(clean), sum(s.rows for s in clean), sum(s.size for s in clean), combined(((s.rows, s.stats) for s in clean), kinds))

    def _parts(self, stripes: list[Stripe], kinds: dict[str, str]) -> tuple[Part, ...]:
        return tuple(self._part(stripes[i : i + PART_STRIPES], kinds) for i in range(0, len(stripes), PART_STRIPES))

    def added(self, m: Manifest, new: list[Stripe]) -> Manifest:
        """m and new stripes, which get the next ids. A last part of under half the size takes them in."""
        given = [replace(s, id=m.next_id + i) for i, s in enumerate(new)]
        parts = m.parts
        if given and parts and parts[-1].count < PART_STRIPES // 2:
            given, parts = self.stripes_of(parts[-1]) + given, parts[:-1]
        return replace(m, parts=parts + self._parts(given, m.kinds), next_id=m.next_id + len(new))

    def without(self, m: Manifest, ids: set[int]) -> Manifest:
        """m without stripes; only the parts that hold them are written anew, and delete vectors go with their last stripe."""
        parts: list[Part] = []
        for p in m.parts:
            own = self.stripes_of(p)
            kept = [s for s in own if s.id not in ids]
            parts += [p] if len(kept) == len(own) else self._parts(kept, m.kinds)
        dirty = {i: n for i, n in m.dirty.items() if i not in ids}
        return replace(m, parts=tuple(parts), dirty=dirty, deletes=tuple(d for d in m.deletes if any(i in dirty for i in d.ids)))

    # -- commits -------------------------------------------------------------------------------------------

    def publish(self, m: Manifest) -> bool:
        temp = f"{FOLDER}/.{uuid.uuid4().hex}.tmp"
        self.store.mkdirs(FOLDER)
        self.store.write(temp, m.to_json())
        if not self.store.publish(temp, f"{FOLDER}/v{m.version:020d}.json"):
            return False
        self.cached[m.version] = replace(m, load=self.stripes_of)
        return True

    def commit(self, change: Callable[[Manifest], Manifest]) -> Manifest:
        """Publish change(latest) as the next version; if a rival was first, change what it published.

        change raises CommitConflict if what the rival did can't be combined with it, and may give back what it got
        where nothing is left to do.
        """
        for _ in range(RETRIES):
            last = self.load()
            changed = change(last)
            if changed is last:
                return last
            new = replace(changed, version=last.version + 1)
            if self.publish(new):
                return self.cached[new.version]
        raise CommitConflict(f"{self.store.root}: version taken by other writers {RETRIES} times")
