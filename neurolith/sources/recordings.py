"""Recording files (CSV, JSON, MAT, NIRS, SNIRF, ZIP) as tables.

``read_recordings(spark, path, table)`` lists and loads the files by Spark and parses them in Arrow batches; ``parsed`` does so for
files that are at hand as rows. ``spark.read.format("recording").option("table", ...).load(path)`` is the same as a data source, for
folders that the driver sees as well. The order of rows in a file is the sample order, hence a file is never split. Files that
cannot be read raise, unless ``mode`` is ``skip``.
"""

from __future__ import annotations

import csv
import io
import json
import os
import statistics
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from neurolith import schema
from neurolith.sources import matfile

# File suffixes, and names that columns and variables go by.
SUFFIXES = (".snirf", ".nirs", ".csv", ".mat", ".zip", ".json")
EVENT_NAMES = ("event", "label", "stim", "trigger", "condition", "class")
SUBJECT_NAMES = ("subject", "subject_id", "participant", "participant_id", "sub")
TIME_NAMES = ("time", "timestamp", "t", "seconds")
SIGNAL_NAMES = ("raw_data", "dataTimeSeries", "data_time_series", "d", "Y", "signal", "signals", "x", "dc", "dod", "hbo", "hbr", "data")
RATE_NAMES = ("sampling_rate", "sample_rate", "fs", "srate", "sfreq")
STIMULUS_NAMES = ("events", "event", "stim", "trigger", "triggers", "s", "labels", "label", "condition", "class")


class RecordingError(ValueError):
    """A file that is no readable recording."""


@dataclass
class Recording:
    """Bands by name, each channels x samples; events as (onset, code, label, subject)."""

    bands: dict[str, np.ndarray]
    rate: float
    channels: list[str]
    events: list[tuple[int, int, str | None, str | None]] = field(default_factory=list)
    labels: dict[int, str] = field(default_factory=dict)
    source_format: str = ""

    def __post_init__(self) -> None:
        raw = self.bands["raw"]
        if raw.ndim != 2 or raw.shape[0] < 1:
            raise RecordingError("a recording needs channels x samples")
        if not self.rate > 0:
            raise RecordingError("the sampling rate must be above 0")
        if len(self.channels) != raw.shape[0]:
            raise RecordingError("one name per channel is needed")
        if any(b.shape != raw.shape for b in self.bands.values()):
            raise RecordingError("all bands must have the shape of the raw data")


def number(cell: str | None) -> float | None:
    """A cell as a number; NaN and infinities count as 0, what is no number as null."""
    try:
        v = float(cell)
    except (TypeError, ValueError):
        return None
    return v if np.isfinite(v) else 0.0


def rate_of(times: list[float]) -> float:
    steps = [b - a for a, b in zip(times[:-1], times[1:], strict=True) if b > a]
    return 1.0 / statistics.median(steps) if steps else 1.0


def has_header(rows: list[list[str]]) -> bool:
    """A known column name, a name that begins with ch, or fewer numbers in the first row than in the second."""
    first = [c.strip().lower() for c in rows[0]]
    if any(c in EVENT_NAMES + SUBJECT_NAMES + TIME_NAMES or c.startswith("ch") for c in first):
        return True
    numeric = lambda row: sum(number(c) is not None for c in row)
    return len(rows) > 1 and numeric(rows[1]) > numeric(rows[0])


def read_csv(raw: bytes) -> Recording:
    """Delimiter, header and column roles are found out; blank rows are dropped, short rows filled with 0.

    Every row of a file with a label column is an event; a missing label is "0", a missing subject the default one.
    """
    text = raw.decode("utf-8-sig", errors="ignore")
    sample = text[:2048]
    try:
        sep = csv.Sniffer().sniff(sample, delimiters=",\t;|").delimiter if sample.strip() else ","
    except csv.Error:
        sep = ","
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if any(c.strip() for c in r)]
    if rows and all(len(r) <= 1 for r in rows) and "," in sample:
        rows = [r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)]
    if not rows:
        raise RecordingError("no rows")
    head = [c.strip() for c in rows.pop(0)] if has_header(rows) else [f"col_{i}" for i in range(len(rows[0]))]
    if not rows:
        raise RecordingError("no rows below the header")
    lower = {c.lower(): i for i, c in reversed(list(enumerate(head)))}
    role = lambda names: next((lower[n] for n in names if n in lower), None)
    label, subject, time = role(EVENT_NAMES), role(SUBJECT_NAMES), role(TIME_NAMES)

    def is_numeric(i: int) -> bool:
        cells = [r[i] for r in rows[:50] if i < len(r)]
        return sum(number(c) is not None for c in cells) >= max(1, int(0.8 * len(cells)))

    used = [i for i in range(len(head)) if i not in (label, subject, time) and is_numeric(i)]
    if not used:
        raise RecordingError("no numeric column")
    cell = lambda r, i: r[i].strip() if i is not None and i < len(r) else ""
    data = np.array([[number(cell(r, i)) or 0.0 for r in rows] for i in used])
    rate = rate_of([number(cell(r, time)) or 0.0 for r in rows if time < len(r)]) if time is not None else 1.0
    events, names = [], {}
    if label is not None:
        shown = [cell(r, label) or "0" for r in rows]
        code = {x: k for k, x in enumerate(sorted(set(shown)))}
        names = {k: x for x, k in code.items()}
        events = [(i, code[x], x, (cell(r, subject) or "subject_0") if subject is not None else None) for i, (x, r) in enumerate(zip(shown, rows, strict=True))]
    return Recording({"raw": data}, rate, [head[i] for i in used], events, names, "csv")


def upright(m) -> np.ndarray:
    """Channels x samples: one channel for a vector, turned where there are more rows than columns; NaN and infinities 0."""
    a = np.squeeze(np.asarray(m, dtype=float))
    a = a[None, :] if a.ndim == 1 else a.reshape(a.shape[0], -1)
    a = a.T if a.shape[0] > a.shape[1] else a
    if a.ndim != 2 or a.shape[1] < 2:
        raise RecordingError("at least two samples are needed")
    return np.where(np.isfinite(a), a, 0.0)


def read_json(raw: bytes) -> Recording:
    p = json.loads(raw.decode("utf-8-sig"))
    if not isinstance(p, dict) or "raw_data" not in p:
        raise RecordingError("raw_data is missing")
    bands = {"raw": upright(p["raw_data"])}
    bands |= {name: upright(p[k]) for k, name in (("hbo", "HbO"), ("hbr", "HbR")) if p.get(k) is not None}
    n = bands["raw"].shape[0]
    labels = {int(k): str(v) for k, v in (p.get("event_id_map") or {}).items()}
    people = p.get("subject_ids") or []
    rows = p.get("events") or []
    if any(len(e) != 3 for e in rows):
        raise RecordingError("events need three columns")
    events = [(int(e[0]), int(e[2]), labels.get(int(e[2]), str(int(e[2]))), str(people[i]) if i < len(people) else None) for i, e in enumerate(rows)]
    return Recording(bands, float(p.get("sampling_rate") or 1.0), list(p.get("channel_names") or [f"Ch{i + 1}" for i in range(n)]), events, labels, "json")


def leaves(tree, name: str = "", depth: int = 0) -> Iterator[tuple[str, int, np.ndarray]]:
    """(name, depth, array) of the numeric arrays in nested structures, at most six levels down."""
    if depth > 6 or name.startswith("__"):
        return
    if isinstance(tree, dict):
        for k, v in tree.items():
            yield from leaves(v, str(k), depth + 1)
    elif isinstance(tree, (list, tuple)) and tree and not np.isscalar(tree[0]):
        for v in tree[:20]:
            yield from leaves(v, name, depth + 1)
    else:
        try:
            a = np.asarray(tree, dtype=float)
        except (TypeError, ValueError):
            return
        if a.size >= 2 and np.isfinite(a).any():
            yield name, depth, a


def find(tree, names: tuple[str, ...]):
    """First value under one of the names, level by level."""
    level = [tree]
    for _ in range(7):
        nested = []
        for t in level:
            if isinstance(t, dict):
                for n in names:
                    if n in t:
                        return t[n]
                nested += list(t.values())
        level = nested
    return None


def stimulus_events(s, n: int) -> list[tuple[int, int]]:
    """(onset, code) of an (n, 3) table, a one-hot matrix or a vector of codes."""
    a = np.squeeze(np.asarray(s, dtype=float))
    if a.ndim == 2 and a.shape[1] == 3:
        return [(int(r[0]), int(r[2])) for r in a]
    if a.ndim == 2 and a.shape[0] == 3 and a.shape[1] != n:
        return [(int(r[0]), int(r[2])) for r in a.T]
    if a.ndim == 2:
        a = a if a.shape[0] >= a.shape[1] else a.T
        return [(i, int(np.flatnonzero(r)[0]) + 1) for i, r in enumerate(a) if r.any()]
    return [(int(i), int(a[i])) for i in np.flatnonzero(a)] if a.ndim == 1 else []


def from_tree(tree: dict, source_format: str) -> Recording:
    """A recording from nested variables: the most signal-like array, its rate and its stimuli."""
    rank = {n.lower(): len(SIGNAL_NAMES) - i for i, n in enumerate(SIGNAL_NAMES)}
    found = [((a.ndim >= 2 and min(a.shape) >= 1 and max(a.shape) >= 2, rank.get(n.lower(), 0), min(a.size, 1_000_000), -d), a) for n, d, a in leaves(tree) if n not in RATE_NAMES + STIMULUS_NAMES[:5] + TIME_NAMES]
    if not found:
        raise RecordingError("no numeric signal")
    raw = upright(max(found, key=lambda x: x[0])[1])
    rate = find(tree, RATE_NAMES)
    times = find(tree, TIME_NAMES)
    value = float(np.ravel(rate)[0]) if rate is not None and np.size(rate) else rate_of(np.ravel(np.asarray(times, float)).tolist()) if times is not None and np.size(times) > 1 else 1.0
    s = find(tree, STIMULUS_NAMES)
    events = [(o, c, str(c), None) for o, c in stimulus_events(s, raw.shape[1])] if s is not None and np.size(s) else []
    return Recording({"raw": raw}, value if value > 0 else 1.0, [f"Ch{i + 1}" for i in range(raw.shape[0])], events, {}, source_format)


def read_mat(raw: bytes) -> Recording:
    try:
        tree = matfile.read(raw)
    except (matfile.MatError, ValueError, IndexError) as e:
        raise RecordingError(f"broken MAT file: {e}") from e
    return from_tree(tree, "mat")


def _text(v) -> str:
    v = np.ravel(v)[0] if np.size(v) else ""
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def _numbered(group: dict, name: str) -> list[dict]:
    """Members name, name1, name2, ... of a group in the order of their numbers."""
    found = [(int(k[len(name) :] or 0), v) for k, v in group.items() if k.startswith(name) and (k[len(name) :] or "0").isdigit() and isinstance(v, dict)]
    return [v for _, v in sorted(found, key=lambda x: x[0])]


def from_snirf(tree: dict) -> Recording:
    """A recording laid out by the SNIRF standard: nirs/data with dataTimeSeries (time x channel), time and measurement lists, and
    stimuli with rows of onset, duration and amplitude in seconds. Codes count the stimuli's names in alphabetical order from 1.

    The time vector may hold just a start and a step. Raises without a data group."""
    nirs = next(iter(_numbered(tree, "nirs")), None)
    block = next(iter(_numbered(nirs or {}, "data")), None)
    if block is None or "dataTimeSeries" not in block:
        raise RecordingError("no nirs/data/dataTimeSeries")
    m = np.asarray(block["dataTimeSeries"], float)
    m = m[:, None] if m.ndim == 1 else m
    times = np.ravel(np.asarray(block.get("time", []), float))
    rate = 1.0 / times[1] if times.size == 2 and m.shape[0] != 2 and times[1] > 0 else rate_of(times.tolist()) if times.size > 1 else 1.0
    start = float(times[0]) if times.size else 0.0
    listed, lengths = _numbered(block, "measurementList"), np.ravel(np.asarray((nirs.get("probe") or {}).get("wavelengths", []), float))

    def channel(i: int) -> str:
        if i >= len(listed):
            return f"Ch{i + 1}"
        c = listed[i]
        at = lambda k: int(np.ravel(c[k])[0]) if k in c else 0
        kind = _text(c["dataTypeLabel"]).lower() if "dataTypeLabel" in c else f"{lengths[at('wavelengthIndex') - 1]:g}" if 0 < at("wavelengthIndex") <= lengths.size else ""
        return f"S{at('sourceIndex')}_D{at('detectorIndex')} {kind}".strip()

    stimuli = [(_text(s.get("name", "")) or str(i + 1), np.atleast_2d(np.asarray(s.get("data", np.zeros((0, 3))), float))) for i, s in enumerate(_numbered(nirs, "stim"))]
    code = {n: k for k, n in enumerate(sorted({n for n, _ in stimuli}), start=1)}
    events = sorted((round((float(r[0]) - start) * rate), code[n], n, None) for n, rows in stimuli for r in rows if r.size)
    return Recording({"raw": np.where(np.isfinite(m), m, 0.0).T}, rate, [channel(i) for i in range(m.shape[1])], events, {k: n for n, k in code.items()}, "snirf")


def read_snirf(raw: bytes) -> Recording:
    """A SNIRF file; one that does not keep to the standard's layout is searched like any nested structure."""
    try:
        import h5py
    except ImportError as e:
        raise RecordingError("SNIRF files need h5py") from e
    with h5py.File(io.BytesIO(raw)) as f:
        tree = lambda g: {k: tree(v) if isinstance(v, h5py.Group) else v[()] for k, v in g.items()}
        whole = tree(f)
    try:
        return from_snirf(whole)
    except RecordingError:
        return from_tree(whole, "snirf")


def safe_members(z: zipfile.ZipFile, suffixes: tuple[str, ...]) -> list[str]:
    """Members with a suffix, hidden ones left out; a path that leads outside raises."""
    out = []
    for n in z.namelist():
        parts = n.replace("\\", "/").split("/")
        if n.startswith(("/", "\\")) or ".." in parts or ":" in parts[0]:
            raise RecordingError(f"unsafe path in archive: {n}")
        if not n.endswith("/") and not any(p.startswith(".") or p == "__MACOSX" for p in parts) and os.path.splitext(n)[1].lower() in suffixes:
            out.append(n)
    return out


def read_zip(raw: bytes) -> Recording:
    """The first member that is a recording; native formats first."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        members = sorted(safe_members(z, tuple(s for s in SUFFIXES if s != ".zip")), key=lambda n: (not n.lower().endswith((".snirf", ".nirs", ".mat")), n))
        errors = []
        for n in members:
            try:
                return parse(n, z.read(n))
            except Exception as e:  # a broken member must not hide a sound one
                errors.append(f"{n}: {e}")
    raise RecordingError("no readable member: " + "; ".join(errors[:5]))


READERS = {".csv": read_csv, ".json": read_json, ".mat": read_mat, ".nirs": read_mat, ".snirf": read_snirf, ".zip": read_zip}


def parse(name: str, raw: bytes) -> Recording:
    suffix = os.path.splitext(name)[1].lower()
    if suffix not in READERS:
        raise RecordingError(f"unsupported suffix {suffix!r}")
    return READERS[suffix](raw)


FIELDS = {
    "signals": pa.schema([("recording_id", pa.string()), ("band", pa.string()), ("channel_idx", pa.int32()), ("channel", pa.string()), ("t", pa.int32()), ("v", pa.float64())]),
    "events": pa.schema([("recording_id", pa.string()), ("event_idx", pa.int32()), ("onset", pa.int64()), ("code", pa.int32()), ("label", pa.string()), ("subject", pa.string())]),
    "recordings": pa.schema(
        [
            ("recording_id", pa.string()), ("source_format", pa.string()), ("source_path", pa.string()), ("sampling_rate", pa.float64()), ("n_channels", pa.int32()),
            ("n_samples", pa.int64()), ("channel_names", pa.list_(pa.string())), ("event_id_map", pa.map_(pa.int32(), pa.string())),
        ]
    ),
}
SCHEMAS = {"signals": schema.SIGNALS, "events": schema.EVENTS, "recordings": schema.RECORDINGS}


def batches_of(path: str, r: Recording, table: str) -> Iterator[pa.RecordBatch]:
    """The rows of one table of a recording: a batch per band and channel, else one batch."""
    rid, raw = os.path.splitext(os.path.basename(path))[0], r.bands["raw"]
    if table == "signals":
        n = raw.shape[1]
        t = pa.array(np.arange(n, dtype=np.int32))
        for band, m in r.bands.items():
            for c, name in enumerate(r.channels):
                same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
                yield pa.RecordBatch.from_arrays([same(rid, pa.string()), same(band, pa.string()), same(c, pa.int32()), same(name, pa.string()), t, pa.array(np.ascontiguousarray(m[c], float))], schema=FIELDS[table])
        return
    rows = [(rid, i, *e) for i, e in enumerate(r.events)] if table == "events" else [(rid, r.source_format, path, r.rate, raw.shape[0], raw.shape[1], r.channels, list(r.labels.items()))]
    columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS[table])
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, FIELDS[table], strict=True)], schema=FIELDS[table])


def parsed(files: DataFrame, table: str = "signals", mode: str = "raise") -> DataFrame:
    """signals, events or recordings of files given as (path, content). mode: raise, or skip those that cannot be read."""
    if table not in FIELDS:
        raise ValueError(f"unknown table {table!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    r = parse(path, raw or b"")
                except (RecordingError, ValueError, zipfile.BadZipFile):
                    if mode == "skip":
                        continue
                    raise
                yield from batches_of(path, r, table)

    return files.select("path", "content").mapInArrow(run, SCHEMAS[table])


def read_recordings(spark: SparkSession, path: str, table: str = "signals", mode: str = "raise") -> DataFrame:
    """A table of all recording files below a folder (or of one file), on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    hidden = F.regexp_extract("path", r"([^/]*)$", 1).startswith(".")
    return parsed(files.filter(suffix.isin(*SUFFIXES) & ~hidden), table, mode)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.table, self.path, self.skip = options.get("table", "signals"), options["path"], options.get("mode") == "skip"
        if self.table not in FIELDS:
            raise ValueError(f"unknown table {self.table!r}")

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        if not os.path.isdir(self.path):
            raise FileNotFoundError(self.path)
        found = sorted(os.path.join(d, f) for d, _, fs in os.walk(self.path) for f in fs if os.path.splitext(f)[1].lower() in SUFFIXES and not f.startswith("."))
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not hasattr(partition, "path"):
            return
        try:
            with open(partition.path, "rb") as f:
                r = parse(partition.path, f.read())
        except (RecordingError, ValueError, zipfile.BadZipFile):
            if self.skip:
                return
            raise
        yield from batches_of(partition.path, r, self.table)


class RecordingSource(DataSource):
    """Name: recording."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "signals")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordingSource)
