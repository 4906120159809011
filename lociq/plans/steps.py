"""A graph of steps that write tables, and resumes where an earlier run ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lociq.sources.config import AUTOSOMES

DONE = "step.json"  # readers pass over names that begin with a line or a dot

Work = Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Step:
    """``work`` makes the step's table from those of the steps and sources that it names in ``after``. ``settings`` (plain values) and
    ``version`` are part of what it is: if they change, it is done again."""

    name: str
    work: Work
    after: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)
    version: int = 1


class StepFailed(RuntimeError):
    """A step's error, with what was done and what was left."""

    def __init__(self, name: str, done: list[str], left: list[str]) -> None:
        super().__init__(f"step {name} failed; done: {', '.join(done) or 'none'}; not run: {', '.join(left) or 'none'}")
        self.name, self.done, self.left = name, done, left


class Store:
    """The folder of a run, in whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def fingerprint(self, path: str) -> str:
        """Of a source: the names, sizes and times of its files."""
        p, fs = self._path(path)
        found = []
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                f = files.next()
                if not f.getPath().getName().startswith((".", "_")):
                    found.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
        if not found:
            raise FileNotFoundError(f"no files in {path}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    def marker(self, name: str) -> dict | None:
        """What the finished step wrote about itself; null if it never finished."""
        p, fs = self._path(f"{self.folder}/{name}/{DONE}")
        if not fs.exists(p):
            return None
        with_lines = self.spark.read.text(f"{self.folder}/{name}/{DONE}", wholetext=True).first()
        try:
            return json.loads(with_lines[0]) if with_lines else None
        except ValueError:
            return None  # cut off while it was written

    def mark(self, name: str, about: dict) -> None:
        """The last thing a step does: a table without a marker counts as not there."""
        p, fs = self._path(f"{self.folder}/{name}/{DONE}.new")
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps(about, sort_keys=True).encode()))
        stream.close()
        fs.rename(p, self._path(f"{self.folder}/{name}/{DONE}")[0])

    def remove(self, name: str) -> bool:
        p, fs = self._path(f"{self.folder}/{name}")
        return fs.delete(p, True)

    def names(self) -> list[str]:
        p, fs = self._path(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/table")


def in_order(steps: list[Step], sources: dict[str, str]) -> list[Step]:
    """The steps so that each comes after what it needs; of several the one named first."""
    by_name = {s.name: s for s in steps}
    if len(by_name) < len(steps) or set(by_name) & set(sources):
        raise ValueError("names of steps and sources must differ")
    out: dict[str, Step] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"steps in a circle: {' -> '.join((*above, name))}")
        if name in out or name in sources:
            return
        if name not in by_name:
            raise ValueError(f"{above[-1]} needs {name}, which is neither a step nor a source")
        for before in by_name[name].after:
            visit(before, (*above, name))
        out[name] = by_name[name]

    for s in steps:
        visit(s.name, ())
    return list(out.values())


def run(spark: SparkSession, folder: str, steps: list[Step], sources: dict[str, str], only: list[str] | None = None) -> dict[str, str]:
    """Do the steps (``only``: these and what they need) whose tables aren't there yet, or were made from something else; by name ``done``
    or ``kept``.

    A step's fingerprint is that of its settings and of all that it reads, down to the files of the sources (Parquet, by path). A finished table of the same
    fingerprint is kept. Anything else of that name is removed first; the table is written, then its marker, so that a run that was
    killed half way is never taken for finished. The first error stops the run; what was done stays.
    """
    store, ordered = Store(spark, folder), in_order(steps, sources)
    if only is not None:
        by_name, wanted, todo = {s.name: s for s in ordered}, set(), list(only)
        while todo:
            name = todo.pop()
            if name in by_name and name not in wanted:
                wanted.add(name)
                todo += by_name[name].after
        ordered = [s for s in ordered if s.name in wanted]
    prints: dict[str, str] = {}
    state: dict[str, str] = {}
    for i, step in enumerate(ordered):
        try:
            for name in step.after:
                if name in sources and name not in prints:
                    prints[name] = store.fingerprint(sources[name])
            about = {"name": step.name, "version": step.version, "settings": step.settings, "after": {n: prints[n] for n in step.after}}
            prints[step.name] = hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()
            marker = store.marker(step.name)
            if marker and marker["fingerprint"] == prints[step.name]:
                state[step.name] = "kept"
                continue
            store.remove(step.name)
            inputs = {n: spark.read.parquet(sources[n]) if n in sources else store.table(n) for n in step.after}
            step.work(spark, inputs).write.parquet(f"{store.folder}/{step.name}/table")
            store.mark(step.name, about | {"fingerprint": prints[step.name]})
            state[step.name] = "done"
        except Exception as error:
            raise StepFailed(step.name, [n for n, s in state.items() if s == "done"], [s.name for s in ordered[i + 1 :]]) from error
    return state


def clean(spark: SparkSession, folder: str, steps: list[Step]) -> list[str]:
    """Remove the folders that belong to none of the steps, and unfinished ones; their names."""
    store, known = Store(spark, folder), {s.name for s in steps}
    gone = [n for n in store.names() if n not in known or store.marker(n) is None]
    for name in gone:
        store.remove(name)
    return gone


def by_chromosome(name: str, work: Callable[[SparkSession, dict[str, DataFrame], str], DataFrame], after: tuple[str, ...] = (), chroms: tuple[str, ...] = AUTOSOMES, **settings) -> list[Step]:
    """A step for each chromosome, named ``name-CHROM``, and one named ``name`` that puts them together: it needs every one, so what comes after it
    starts only when all chromosomes are there."""

    def part(chrom: str) -> Work:
        return lambda spark, tables: work(spark, tables, chrom)

    def whole(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
        out = None
        for c in chroms:
            own = tables[f"{name}-{c}"]
            out = own if out is None else out.unionByName(own)
        return out

    each = [Step(f"{name}-{c}", part(c), after, settings | {"chrom": c}) for c in chroms]
    return [*each, Step(name, whole, tuple(s.name for s in each), settings)]
