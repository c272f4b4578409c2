"""Tables in numbered versions: atomic commits, enforced keys, changes that cost what they change.

A version is one file, commits/N, made only if it is absent, so of two writers that start from one version the second finds its number
taken, looks at the new version and tries again. A version names the Parquet folders that it is made of: base files dealt to buckets by the
first key column, and deltas, which hold the rows of an upsert or the keys of a delete. Data is written before the version that names
it: a job that dies at any step leaves the version before, and what it wrote is nobody's until `vacuum`.

Reading puts the newest delta row of a key in the place of its base row. Deltas that are many are merged with each other; once they
have more than SHARE of the base's rows, the buckets that they touch are written anew and the others stay. A reader's frame is the version
that it was opened at, until `vacuum` removes its folders.

Create-if-absent is a hard link on a local disk and a rename that does not replace elsewhere (as on HDFS): a store with neither is unsafe for two writers.
"""

from __future__ import annotations

import json
import os
import time
import urllib.parse
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deltas that a read merges at most, and the share of the base's rows that they may have.
DELTAS, SHARE = 8, 0.25
TRIES = 20


class KeyRefused(ValueError):
    """A key is null, repeated, or held by another row."""


class Conflict(RuntimeError):
    """Other writers were faster, again and again."""


@dataclass(frozen=True)
class Version:
    """base: (bucket, folder, rows); deltas, oldest first: (folder, rows, whether it holds keys that are gone)."""

    number: int = 0
    base: tuple[tuple[int, str, int], ...] = ()
    deltas: tuple[tuple[str, int, bool], ...] = ()

    def folders(self) -> set[str]:
        return {b[1] for b in self.base} | {d[0] for d in self.deltas}


@dataclass(frozen=True)
class Log:
    """Numbered versions below a folder, each a JSON file that is there whole or not at all."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _put(self, name: str, content: str) -> bool:
        """Make a file with this content, whole or not at all; False if it is there already."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, target = self._fs(f"{self.path}/{name}")
        _, draft = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                local = [urllib.parse.unquote(fs.makeQualified(p).toUri().getRawPath()) for p in (draft, target)]
                os.link(*local)
            else:
                keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, keep)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.getClass().getName()):
                raise
            return False
        finally:
            fs.delete(draft, False)
        return True

    def _text(self, name: str) -> str:
        fs, at = self._fs(f"{self.path}/{name}")
        stream = fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _list(self, name: str) -> list[Any]:
        fs, at = self._fs(f"{self.path}/{name}")
        return list(fs.listStatus(at)) if fs.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()) for s in self._list("commits") if s.getPath().getName().isdigit())

    def told(self, number: int | None = None) -> tuple[int, Any]:
        """The number and content of a version, or of the newest; 0 and None before the first."""
        held = self.numbers()
        number = number if number is not None else held[-1] if held else 0
        return number, json.loads(self._text(f"commits/{number:012d}")) if number else None

    def commit(self, plan: Callable[[int, Any], tuple[Any, Any]]) -> Any:
        """plan(number, content) gives what comes after the newest version and a result; if another commit came first, it is asked again. None commits nothing."""
        for _ in range(TRIES):
            number, now = self.told()
            new, result = plan(number, now)
            if new is None or self._put(f"commits/{number + 1:012d}", json.dumps(new)):
                return result
        raise Conflict(f"{self.path}: {TRIES} commits by others came first")


@dataclass(frozen=True)
class Table(Log):
    """key: the columns that tell rows apart, enforced at every write; unique: further columns that no two rows share. Without a key, rows are only added or replaced."""

    schema: str = ""
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    buckets: int = 16

    # ---- versions ---------------------------------------------------------------------------------------------
    def version(self, number: int | None = None) -> Version:
        """A version by its number, or the newest; before the first commit an empty one."""
        return self._parsed(*self.told(number))

    @staticmethod
    def _parsed(number: int, told: Any) -> Version:
        return Version() if told is None else Version(number, tuple(map(tuple, told["base"])), tuple(map(tuple, told["deltas"])))

    def _change(self, plan: Callable[[Version], tuple[Version | None, Any]]) -> Any:
        """Commit what `plan` makes of the newest version."""

        def step(number: int, now: Any) -> tuple[Any, Any]:
            new, result = plan(self._parsed(number, now))
            return None if new is None else {"base": new.base, "deltas": new.deltas}, result

        return self.commit(step)

    # ---- reading ----------------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return T.StructType.fromDDL(self.schema).names

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key[0]), F.lit(self.buckets)).cast("int") if self.key else F.lit(0)

    def _rows(self, folders: list[str], schema: str | None = None) -> DataFrame:
        schema = schema or self.schema
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _deltas(self, v: Version) -> DataFrame:
        """(columns, _gone): the newest change of every key in the deltas."""
        out = None
        for i, (folder, _, gone) in enumerate(v.deltas):
            rows = self._rows([folder]).select("*", F.lit(gone).alias("_gone"), F.lit(i).alias("_seq"))
            out = rows if out is None else out.union(rows)
        last = out.groupBy(*self.key).agg(F.max_by(F.struct(*[c for c in out.columns if c not in self.key]), "_seq").alias("x"))
        return last.select(*[F.col(c) if c in self.key else F.col(f"x.{c}") for c in self.columns], "x._gone")

    def _merged(self, v: Version, base: DataFrame) -> DataFrame:
        if not v.deltas:
            return base
        changed = self._deltas(v)
        return base.join(changed.select(*self.key), list(self.key), "left_anti").select(*self.columns).union(changed.filter(~F.col("_gone")).drop("_gone"))

    def read(self, version: int | None = None, first: Any = None) -> DataFrame:
        """The rows of a version. first: only rows whose first key column has this value; their bucket alone is read."""
        v = self.version(version)
        if first is None:
            return self._merged(v, self._rows([f for _, f, _ in v.base]))
        own = self.spark.createDataFrame([(first,)], self._rows([]).select(self.key[0]).schema).select(self._bucket()).first()[0]
        where = F.col(self.key[0]) == F.lit(first)
        return self._merged(v, self._rows([f for b, f, _ in v.base if b == own])).filter(where)

    def changes(self, since: int) -> DataFrame:
        """(columns, _gone) of the keys that changed after a version: their rows now, or, where `_gone`, the key alone.

        Reads the deltas that came since; if buckets were written anew in between, both versions' rows in those buckets are compared.
        """
        then, now = self.version(since), self.version()
        if then.base == now.base and now.deltas[: len(then.deltas)] == then.deltas:
            newer = Version(now.number, (), now.deltas[len(then.deltas) :])
            return self._deltas(newer) if newer.deltas else self._rows([]).withColumn("_gone", F.lit(False))
        kept = set(then.base) & set(now.base)
        apart = [self._merged(v, self._rows([f for b, f, n in v.base if (b, f, n) not in kept])) for v in (then, now)]
        print_ = lambda rows: rows.withColumn("_print", F.xxhash64(*self.columns))
        new = print_(apart[1]).join(print_(apart[0]).select(*self.key, "_print"), [*self.key, "_print"], "left_anti").select(*self.columns, F.lit(False).alias("_gone"))
        lost = apart[0].join(apart[1].select(*self.key), list(self.key), "left_anti")
        kinds = dict(lost.dtypes)
        return new.union(lost.select(*[F.col(c) if c in self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns], F.lit(True).alias("_gone")))

    # ---- changes ----------------------------------------------------------------------------------------------
    def _write(self, rows: DataFrame, bucketed: bool) -> tuple[str, list[tuple[int, str, int]]]:
        """Write rows to a folder of their own; (folder, (bucket, folder, rows) of each bucket)."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*self.columns)
        if not bucketed:
            rows.write.parquet(f"{self.path}/{folder}")
            return folder, [(0, folder, self._rows([folder]).count())]
        dealt = rows.withColumn("_bucket", self._bucket())
        if self.key:  # a bucket that one key fills is written by several tasks
            dealt = dealt.repartition("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)))
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        found = sorted(int(s.getPath().getName().split("=")[1]) for s in self._list(folder) if "=" in s.getPath().getName())
        return folder, [(b, f"{folder}/_bucket={b}", self._rows([f"{folder}/_bucket={b}"]).count()) for b in found]

    def _sound(self, rows: DataFrame) -> None:
        """Keys of incoming rows: none null, none twice."""
        for columns in (self.key, *self.unique):
            if not columns:
                continue
            missing = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
            if columns == self.key and not rows.filter(missing).limit(1).isEmpty():
                raise KeyRefused(f"{self.path}: a key ({', '.join(columns)}) is null")
            if not rows.filter(~missing).groupBy(*columns).count().filter("count > 1").limit(1).isEmpty():
                raise KeyRefused(f"{self.path}: a key ({', '.join(columns)}) is repeated")

    def _free(self, rows: DataFrame, held: DataFrame) -> None:
        """Further unique columns of incoming rows that a row with another key holds."""
        for columns in self.unique:
            other = held.select(*columns, F.struct(*self.key).alias("_held"))
            met = rows.select(*columns, F.struct(*self.key).alias("_own")).join(other, list(columns)).filter("_held <> _own")
            if not met.limit(1).isEmpty():
                raise KeyRefused(f"{self.path}: another row has the same {', '.join(columns)}")

    def _tidied(self, v: Version) -> Version:
        """A version with few deltas: merged with each other, or into the buckets that they touch."""
        changed, held = sum(d[1] for d in v.deltas), sum(b[2] for b in v.base)
        if changed > SHARE * held and changed:
            return self._folded(v)
        if len(v.deltas) <= DELTAS:
            return v
        newest = self._deltas(v)
        deltas = []
        for gone in (False, True):
            folder, parts = self._write(newest.filter(F.col("_gone") == gone), False)
            deltas += [(folder, parts[0][2], gone)] * bool(parts[0][2])
        return Version(v.number, v.base, tuple(deltas))

    def _folded(self, v: Version) -> Version:
        """No deltas: the buckets that they touch are written anew."""
        touched = [r[0] for r in self._deltas(v).select(self._bucket().alias("b")).distinct().collect()] if v.deltas else []
        _, new = self._write(self._merged(v, self._rows([f for b, f, _ in v.base if b in touched])), True)
        return Version(v.number, tuple(sorted([x for x in v.base if x[0] not in touched] + [x for x in new if x[2]])), ())

    def _add(self, v: Version, folder: str, n: int, gone: bool) -> Version:
        return self._tidied(Version(v.number, v.base, (*v.deltas, (folder, n, gone))))

    def upsert(self, rows: DataFrame) -> int:
        """Rows take the place of those with their key; how many rows came. Writes them, and no held row."""
        folder, parts = self._write(rows, False)
        written, n = self._rows([folder]), parts[0][2]
        self._sound(written)

        def plan(now: Version) -> tuple[Version | None, int]:
            if self.unique:
                self._free(written, self._merged(now, self._rows([f for _, f, _ in now.base])))
            return (self._add(now, folder, n, False) if n else None), n

        return self._change(plan)

    def insert(self, rows: DataFrame) -> int:
        """Rows with new keys; a key that is held is refused, and then nothing is written."""
        folder, parts = self._write(rows, False)
        written, n = self._rows([folder]), parts[0][2]
        self._sound(written)

        def plan(now: Version) -> tuple[Version | None, int]:
            held = self._merged(now, self._rows([f for _, f, _ in now.base]))
            if not written.join(held.select(*self.key), list(self.key), "left_semi").limit(1).isEmpty():
                raise KeyRefused(f"{self.path}: a key is held already")
            self._free(written, held)
            return (self._add(now, folder, n, False) if n else None), n

        return self._change(plan)

    def insert_absent(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows whose `keys` are new, one each; held ones stay. How many came."""
        rows = rows.select(*self.columns)

        def plan(now: Version) -> tuple[Version | None, int]:
            held = self._merged(now, self._rows([f for _, f, _ in now.base]))
            new = rows.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti")
            if not self.key:
                folder, parts = self._write(new, True)
                return Version(now.number, (*now.base, *parts), now.deltas), sum(p[2] for p in parts)
            folder, parts = self._write(new, False)
            written, n = self._rows([folder]), parts[0][2]
            self._sound(written)
            self._free(written, held)
            return (self._add(now, folder, n, False) if n else None), n

        return self._change(plan)

    def delete(self, where: Column, first: Any = None) -> int:
        """Rows that meet a condition go; how many. Writes their keys. first: as in `read`."""

        def plan(now: Version) -> tuple[Version | None, int]:
            rows = self.read(now.number, first) if now.number else self._rows([])
            kinds = dict(rows.dtypes)
            keys = rows.filter(where).select(*[F.col(c) if c in self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns])
            folder, parts = self._write(keys, False)
            return (self._add(now, folder, parts[0][2], True) if parts[0][2] else None), parts[0][2]

        return self._change(plan)

    def delete_matching(self, firsts: DataFrame) -> DataFrame:
        """Rows whose first key column is among `firsts` (one column) go, in one commit; (that column, n) of those that had rows."""
        firsts = firsts.select(F.col(firsts.columns[0]).alias(self.key[0])).distinct()

        def plan(now: Version) -> tuple[Version | None, DataFrame]:
            kinds = dict(self._rows([]).dtypes)
            rows = self.read(now.number) if now.number else self._rows([])
            keys = rows.join(firsts, self.key[0], "left_semi").select(*[F.col(c) if c in self.key else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns])
            folder, parts = self._write(keys, False)
            told = self._rows([folder]).groupBy(self.key[0]).agg(F.count("*").alias("n"))
            return (self._add(now, folder, parts[0][2], True) if parts[0][2] else None), told

        return self._change(plan)

    def replace(self, rows: DataFrame) -> None:
        """All rows anew."""
        folder, parts = self._write(rows, True)
        self._sound(self._rows([p[1] for p in parts]))
        self._change(lambda now: (Version(now.number, tuple(p for p in parts if p[2]), ()), None))

    def reset(self) -> None:
        self._change(lambda now: (Version(now.number), None))

    def compact(self) -> None:
        """No deltas any more."""
        self._change(lambda now: (self._folded(now) if now.deltas else None, None))

    def vacuum(self, keep: int = 1, older_than_seconds: float = 3600.0) -> int:
        """Folders that none of the newest `keep` versions names and that are older go; how many. Versions before those cannot be read any more."""
        numbers = self.numbers()[-keep:]
        named = {f for n in numbers for f in self.version(n).folders()}
        before, gone = (time.time() - older_than_seconds) * 1000, 0
        for top in self._list("data"):
            name = f"data/{top.getPath().getName()}"
            if top.getModificationTime() >= before:
                continue
            parts = [f"{name}/{s.getPath().getName()}" for s in self._list(name) if "=" in s.getPath().getName()] or [name]
            idle = [p for p in parts if p not in named]
            for p in [name] if len(idle) == len(parts) else idle:
                fs, at = self._fs(f"{self.path}/{p}")
                gone += bool(fs.delete(at, True))
        for n in self.numbers()[:-keep]:
            fs, at = self._fs(f"{self.path}/commits/{n:012d}")
            if fs.getFileStatus(at).getModificationTime() < before:
                fs.delete(at, False)
        return gone
