"""A home for evidence, samples and profiles, on any file system that Spark writes to; profiles are rebuilt from it.

evidence/  the append-only log, JSON lines          samples/  (text_ref, text), appended
profiles/  versions: data-<name>/ holds the documents of all writers and what their log was when they were built,
           commits/<number> names one of them and is written last

A version is a folder of its own, and nothing of an older one is ever changed: a reader sees the version that it began with,
or a later one, but never none or half of one, wherever a writer stops. A commit file is created under the next number
only if nobody has it: of two writers that started from the same version one gets a Conflict, and nothing is lost.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idiolect.operators import contexts, profile, render
from idiolect.operators.keys import joined
from idiolect.sources import evidence, files
from idiolect.sources.scratch import cut


class Conflict(OSError):
    """Another writer committed since the version that this one started from."""


@dataclass(frozen=True)
class Version:
    """A committed version: its number, its data folder and the last batch of each stream that it has."""

    number: int
    data: str
    batches: dict[str, int]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    home: str

    @classmethod
    def open(cls, spark: SparkSession, home: str | None = None) -> Store:
        return cls(spark, files.home(home).rstrip("/"))

    def path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def exists(self, name: str = "profiles") -> bool:
        """Whether there is anything of that name; of profiles, a committed version."""
        if name == "profiles":
            return self.version() is not None
        at, system = self._at(name)
        return system.exists(at)

    def _at(self, name: str):
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at, at.getFileSystem(context._jsc.hadoopConfiguration())

    # --- evidence and samples
    def add(self, texts: DataFrame, kind: str = "writing_sample", timestamp: str | None = None) -> None:
        """Samples first, then their records: a record never refers to a text that was not stored. Blank texts are left
        out. texts: writer, seq, source, text, and context, prompt, targets where they have them."""
        made = evidence.records(texts, kind, None if timestamp is None else F.lit(timestamp)).where("text <> ''")
        made.select("text_ref", "text").write.mode("append").parquet(self.path("samples"))
        evidence.append(made, self.path("evidence"))

    def add_choices(self, choices: DataFrame, timestamp: str | None = None) -> None:
        """choices: writer, seq, pair_id, formal, plain, chosen."""
        evidence.append(evidence.choice_records(choices, None if timestamp is None else F.lit(timestamp)), self.path("evidence"))

    def log(self) -> DataFrame:
        """Every record in order: (writer, seq) and the record's fields. A record that was appended again counts once."""
        return evidence.in_order(evidence.read(self.spark, self.path("evidence")).dropDuplicates(["writer", "id"]))

    def samples(self) -> DataFrame:
        """(writer, seq, context, text) of the records whose text is still there."""
        if not self.exists("samples"):
            return self.spark.createDataFrame([], "writer string, seq long, context string, text string")
        stored = self.spark.read.parquet(self.path("samples")).groupBy("text_ref").agg(F.first("text").alias("text"))  # equal refs, equal texts
        return evidence.labelled_samples(self.log(), stored).select("writer", "seq", "context", "text")

    def marks(self) -> DataFrame:
        """(writer, records, mark): how many records a writer's log has, and a number that changes with any of them."""
        named = self.log().select("writer", F.xxhash64("id", "timestamp").alias("h"))
        return named.groupBy("writer").agg(F.count(F.lit(1)).alias("records"), F.bit_xor("h").alias("mark"))

    # --- versions
    def version(self, number: int | None = None) -> Version | None:
        """The last version, or the one of a number; None where there is none. What is no complete commit is none."""
        at, system = self._at("profiles/commits")
        if not system.exists(at):
            return None
        names = sorted((f.getPath().getName() for f in system.listStatus(at)), reverse=True)
        for name in names:
            if name.isdigit() and number in (None, int(name)):
                try:
                    said = json.loads("\n".join(r.value for r in self.spark.read.text(self.path(f"profiles/commits/{name}")).collect()))  # one line
                    return Version(int(name), said["data"], said["batches"])
                except ValueError:
                    continue  # its writer stopped before it was whole
        return None

    def _number(self) -> int:
        """The next number, whether the commits before it are whole or not."""
        at, system = self._at("profiles/commits")
        taken = [int(f.getPath().getName()) for f in system.listStatus(at) if f.getPath().getName().isdigit()] if system.exists(at) else []
        return max(taken, default=0) + 1

    def _commit(self, number: int, data: str, batches: dict[str, int]) -> None:
        at, system = self._at(f"profiles/commits/{number:012d}")
        try:
            out = system.create(at, False)
        except Exception as e:
            if "exists" in str(e).lower():
                raise Conflict(f"version {number} was committed by another writer") from e
            raise
        out.write(bytearray(json.dumps({"data": data, "batches": batches}).encode()))
        out.close()

    # --- profiles
    def rebuild(self, now: str, whole: bool = False, batch: tuple[str, int] | None = None) -> DataFrame:
        """Profiles of all writers from the log and the samples, committed as the next version. Built are those writers
        alone whose log is not what it was in the last version, or all; the others' documents are carried over. A writer
        keeps the time of the first one. batch: a stream's name and number, committed with the profiles."""
        number, old = self._number(), self.version()
        marks = cut(self.marks(), "marks")
        batches = ({} if old is None else old.batches) | ({} if batch is None else {batch[0]: batch[1]})
        verdicts = evidence.verdicts(self.log()).select("writer", "seq", "formal", "plain", "chosen")
        if old is None:
            self.save(profile.build(self.samples(), verdicts, now), marks, number, batches)
            return self.load()  # type: ignore[return-value]
        before = self.spark.read.parquet(self.path(f"profiles/{old.data}"))
        same = before.select("writer", "records", "mark")
        changed = cut((marks if whole else marks.join(same, ["writer", "records", "mark"], "left_anti")).select("writer"), "changed")
        kept = profile.parsed(joined(before.select("writer", "json"), changed, ["writer"], "left_anti")).withColumn("metadata", F.col("metadata").withField("updated_at", F.lit(now)))
        if changed.isEmpty():
            self.save(kept, marks, number, batches)
            return self.load()  # type: ignore[return-value]
        made = profile.build(joined(self.samples(), changed, ["writer"], "left_semi"), joined(verdicts, changed, ["writer"], "left_semi"), now)
        first = profile.parsed(before.select("writer", "json")).select("writer", F.col("metadata.created_at").alias("first"))
        made = joined(made, first, ["writer"], "left").withColumn("metadata", F.col("metadata").withField("created_at", F.coalesce("first", F.lit(now)))).drop("first")
        self.save(made.select(kept.columns).unionByName(kept), marks, number, batches)
        return self.load()  # type: ignore[return-value]

    def start_contexts(self, requests: DataFrame, now: str) -> DataFrame:
        """The outcomes of requests (writer, seq, context, text; seq is their order) for contexts, as contexts.outcomes() has
        them. Texts that start a context, or bring it nearer, come after what their writers' logs have, and the profiles are
        rebuilt; if nothing is kept they stay as they are. Asked again after a crash, a request finds what was stored."""
        profiles = self.load()
        if profiles is None:
            profiles = self.spark.createDataFrame([], "writer string")
        found = cut(contexts.outcomes(self.samples(), requests, profiles.select("writer")), "outcomes")
        last = self.log().where(F.col("seq") < evidence.LATE).groupBy("writer").agg(F.max("seq").alias("last"))
        new = cut(joined(contexts.kept(requests.select("writer", "seq", "context", "text"), found), last, ["writer"], "left"), "requests")
        if new.isEmpty():
            if self.exists():
                self.rebuild(now)
            return found
        self.add(new.select("writer", (F.coalesce("last", F.lit(-1)) + 1 + F.col("seq")).alias("seq"), F.lit("pasted").alias("source"), "context", "text"), timestamp=now)
        self.rebuild(now)
        return found

    def save(self, profiles: DataFrame, marks: DataFrame | None = None, number: int | None = None, batches: dict[str, int] | None = None) -> None:
        """Checked, written as a folder of their own, then committed: as the version of a number that was free when the
        work began, or the next one. marks: what the writers' logs were."""
        number = self._number() if number is None else number
        bad = profile.errors(profiles)
        text = F.when(F.size(bad) == 0, profile.to_json(profiles)).otherwise(F.raise_error(F.array_join(bad, "; ")))
        data = f"data-{number:012d}-{uuid.uuid4().hex}"
        rows = profiles.select("writer", text.alias("json"))
        if marks is None:
            rows = rows.withColumns({"records": F.lit(0).cast("long"), "mark": F.lit(0).cast("long")})  # like no log: built again next time
        else:
            rows = joined(rows, marks, ["writer"], "left")
        rows.select("writer", "json", "records", "mark").write.parquet(self.path(f"profiles/{data}"))
        self._commit(number, data, batches or {})

    def load(self, number: int | None = None) -> DataFrame | None:
        """The profiles of the last version, or of the one of a number; None where there is none."""
        version = self.version(number)
        return None if version is None else profile.parsed(self.spark.read.parquet(self.path(f"profiles/{version.data}")).select("writer", "json"))


def write_block(path: str, block: str, tool: str = render.TOOL, spark: SparkSession | None = None) -> str:
    """Put a block of instructions into a local text file; created, appended or replaced. A file that is not UTF-8 or whose
    markers make no sense is left alone, as a ValueError."""
    spark = spark or SparkSession.active()
    try:
        with open(path, encoding="utf-8", newline="") as f:
            existing = f.read()
    except FileNotFoundError:
        existing = None
    except UnicodeDecodeError as e:
        raise ValueError(f"{path} is not UTF-8 text, so it was left alone") from e
    row = spark.createDataFrame([(existing, block)], "existing string, block string").select(F.inline(F.array(render.splice(F.col("existing"), F.col("block"), tool)))).first()
    if row.error:
        raise ValueError(f"{path}: {row.error}")
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(row.text)
    return row.action
