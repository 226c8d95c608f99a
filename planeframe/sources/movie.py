"""Movies: files of atoms with one video track, audio tracks and a timecode track.

Reading looks at the index alone (`moov`), one file a row; sample tables come out as arrays and are expanded by
DataFrame operators. Writing is one file a row too: files don't depend on each other. Sample tables are arrays of numbers
all the way, and workers hold one file beside the Arrow batch that it came in (64 MB, by Spark's setting)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from planeframe.sources.packet import MAGIC

# Containers whose children are atoms, and limits.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "udta", "dinf", "gmhd", "wave"}
MOST_SAMPLES = 1 << 26
UINT32 = (1 << 32) - 1
FPS = (24, 25, 30, 48, 50, 60)
RATES = (44100, 48000, 88200, 96000, 176400, 192000)
LAYOUTS = {1: 1, 2: 2, 6: 3, 8: 4}  # channels: layout (mono, stereo, 5.1, 7.1)
LAYOUT_TAGS = {1: 0x640001, 2: 0x650002, 6: 0x8C0006, 8: 0x8E0008}


class Malformed(ValueError):
    """The file breaks the format."""


# ---- reading ------------------------------------------------------------------------------------------------


def atoms(data: bytes, lo: int = 0, hi: int | None = None, path: str = "") -> Iterator[tuple[str, int, int, int]]:
    """(path, offset, header bytes, size) of all atoms between two places, containers before their children. A
    64-bit size follows a size of 1; an `mdat` that reaches over the end of the file ends there."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise Malformed("an atom's header is cut off")
        size, head = int.from_bytes(data[lo : lo + 4], "big"), 8
        kind = data[lo + 4 : lo + 8].decode("latin-1")
        if size == 1:
            if hi - lo < 16:
                raise Malformed("a 64-bit size is cut off")
            size, head = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
        if kind == "mdat" and not path:
            size = min(size, hi - lo)
        if size < head or lo + size > hi:
            raise Malformed(f"size of {kind}")
        here = f"{path}/{kind}" if path else kind
        yield here, lo, head, size
        if kind in CONTAINERS:
            yield from atoms(data, lo + head, lo + size, here)
        lo += size


def _table(body: bytes, columns: int = 1, kind: str = ">u4") -> np.ndarray:
    """The entries of a full atom with a count, a row each."""
    n, width = int.from_bytes(body[4:8], "big"), columns * np.dtype(kind).itemsize
    if n > MOST_SAMPLES or len(body) < 8 + n * width:
        raise Malformed("more entries than bytes")
    out = np.frombuffer(body, kind, n * columns, 8)
    if kind == ">u8" and (out >> 62).any():
        raise Malformed("an offset beyond any file")
    return out.astype(np.int64).reshape(n, columns)


def _checked(body: bytes, magic: bytes) -> bytes:
    if body[:4] != magic or body[4:6] != b"\0\1" or zlib.crc32(body[:-4]) != int.from_bytes(body[-4:], "big"):
        raise Malformed(magic.decode())
    return body


def _config(body: bytes) -> dict:
    names = ("profile", "pixel_format", "bit_depth", "qmatrix_id", "qp_base", "alpha_mode", "alpha_bit_depth", "flags", "color_primaries", "color_transfer", "color_matrix", "chroma_siting")
    out = dict(zip(names, body[6:18]))
    out["sar_num"], out["sar_den"] = struct.unpack(">HH", body[18:22])
    return out


@dataclass
class Placed:
    """Samples by columns: offset, size, pts, duration and sync of each."""

    off: np.ndarray
    size: np.ndarray
    pts: np.ndarray
    dur: np.ndarray
    sync: np.ndarray

    def __len__(self) -> int:
        return len(self.off)

    def tuples(self) -> list[tuple[int, int, int, int, bool]]:
        return list(zip(self.off.tolist(), self.size.tolist(), self.pts.tolist(), self.dur.tolist(), self.sync.tolist()))


_NONE, _NO_ROWS = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)


@dataclass
class Track:
    kind: str = ""
    timescale: int = 0
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    entry: bytes = b""
    edit: int = 0

    def samples(self) -> Placed:
        times, sizes = self.tables.get("stts", _NO_ROWS), self.tables.get("stsz", _NONE)
        if times[:, 0].sum() != len(sizes) or (times[times[:, 0] > 0, 1] < 1).any():
            raise Malformed("durations and sizes")
        durations = np.repeat(times[:, 1], times[:, 0])
        chunks, runs = self.tables.get("stco", _NONE), self.tables.get("stsc", _NO_ROWS)
        if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
            raise Malformed("chunk runs")
        sync = self.tables.get("stss")
        if sync is not None and ((sync < 1) | (sync > len(sizes))).any():
            raise Malformed("sync samples")
        if len(runs) and (runs[1:, 0] - 1 > len(chunks)).any():
            raise Malformed("chunk offsets")
        used = np.maximum(np.append(runs[1:, 0] - 1, len(chunks))[: len(runs)] - runs[:, 0] + 1, 0)
        if (used * runs[:, 1]).sum() != len(sizes):
            raise Malformed("chunks and samples")
        per = np.repeat(runs[:, 1], used)
        chunks = chunks[: len(per)][per > 0]
        per = per[per > 0]
        inside = np.cumsum(sizes) - sizes  # bytes before each sample; less those before its chunk, its place there
        off = np.repeat(chunks - inside[np.cumsum(per) - per], per) + inside
        is_sync = np.full(len(sizes), sync is None)
        if sync is not None:
            is_sync[sync - 1] = True
        return Placed(off, sizes, np.cumsum(durations) - durations, durations, is_sync)


def read(data: bytes) -> dict:
    """The index of one file: samples (offset, size, pts, duration, sync) of the video track, its configuration and
    metadata, audio tracks, timecode."""
    out = columns_of(data)
    return {**out, "samples": out["samples"].tuples(), "audio": [{**a, "chunks": a["chunks"].tuples()} for a in out["audio"]]}


def columns_of(data: bytes) -> dict:
    """As read(), with samples and chunks by columns."""
    found = list(atoms(data))
    top = [p for p, *_ in found if "/" not in p]
    if not top or top[0] != "ftyp" or top.count("moov") != 1 or "mdat" not in top:
        raise Malformed("top level")
    tracks: list[Track] = []
    media = [(at + head, at + size) for path, at, head, size in found if path == "mdat"]
    for path, at, head, size in found:
        name, body = path.rsplit("/", 1)[-1], data[at + head : at + size]
        if name == "trak":
            tracks.append(Track())
        if not tracks or "/trak" not in path:
            continue
        t = tracks[-1]
        if name == "mdhd":
            t.timescale = int.from_bytes(body[12:16], "big")
        elif name == "hdlr" and path.endswith("mdia/hdlr"):
            t.kind = body[8:12].decode("latin-1")
        elif name in ("stts", "stsc", "stsz", "stss", "stco", "co64", "stsd"):
            key = "stco" if name == "co64" else name
            if key in t.tables:
                raise Malformed(f"two {name}")
            if name == "stsz":
                uniform, n = struct.unpack(">II", body[4:12])
                if n > MOST_SAMPLES:
                    raise Malformed("too many samples")
                t.tables[key] = np.full(n, uniform, np.int64) if uniform else _table(body[4:])[:, 0]
            elif name == "stsd":
                if body[4:8] != b"\0\0\0\1":
                    raise Malformed("sample entries")
                t.tables[key], t.entry = _NONE, body[8:]
            else:
                rows = _table(body, {"stts": 2, "stsc": 3}.get(name, 1), ">u8" if name == "co64" else ">u4")
                t.tables[key] = rows if name in ("stts", "stsc") else rows[:, 0]
        elif name == "elst":
            t.edit = struct.unpack(">i", body[12:16])[0]
    video = [t for t in tracks if t.kind == "vide"]
    if len(video) != 1 or video[0].entry[4:8].decode("latin-1") != MAGIC or any(t.kind not in ("vide", "soun", "tmcd") for t in tracks):
        raise Malformed("tracks")
    out: dict = {"timescale": video[0].timescale, "width": 0, "height": 0, "faststart": top.index("moov") < top.index("mdat"), "tier": 0, "vendor": "", "label": "", "budget": None, "raw": None}
    entry = video[0].entry
    out["width"], out["height"] = struct.unpack(">HH", entry[32:36])
    for path, at, head, size in atoms(entry, 86, len(entry)):
        body = entry[at + head : at + size]
        if path == "tpcC":
            out["config"] = _config(_checked(body, b"TPCC"))
        elif path == "tpcB":
            mode, depth, target, actual, error, flags, frames = struct.unpack(">BBHHHHI", _checked(body, b"TPCB")[6:20])
            out["budget"] = {"alpha_mode": mode, "alpha_bit_depth": depth, "target_bp": target, "actual_bp": actual, "max_error": error, "flags": flags, "frames": frames}
        elif path == "tpcD":
            _checked(body, b"TPCD")
            tier, zero, v, n = struct.unpack(">BBHH", body[6:12])
            if tier > 8 or zero or v > 15 or n > 63 or len(body) != 16 + v + n:
                raise Malformed("tpcD")
            out["tier"], out["vendor"], out["label"] = tier, body[12 : 12 + v].decode(), body[12 + v : 12 + v + n].decode()
        elif path == "trwm":
            out["raw"] = body
    if "config" not in out:
        raise Malformed("no configuration")
    out["samples"] = placed = video[0].samples()
    held = np.zeros(len(placed), bool)
    for lo, hi in media:
        held |= (placed.off >= lo) & (placed.off < hi) & (placed.size <= hi - placed.off)
    if not held.all():
        raise Malformed("a sample outside the data")
    if out["budget"] and out["budget"]["frames"] != len(out["samples"]):
        raise Malformed("budget frames")
    out["audio"] = []
    for t in tracks:
        if t.kind == "soun":
            version = struct.unpack(">H", t.entry[16:18])[0]
            rate = round(struct.unpack(">d", t.entry[40:48])[0]) if version == 2 else int.from_bytes(t.entry[32:34], "big")
            channels = int.from_bytes(t.entry[48:52] if version == 2 else t.entry[24:26], "big")
            if rate != t.timescale:
                raise Malformed("audio rate")
            out["audio"].append({"codec": t.entry[4:8].decode("latin-1"), "rate": rate, "channels": channels, "priming": t.edit, "chunks": t.samples()})
    clock = [t for t in tracks if t.kind == "tmcd"]
    if len(clock) > 1:
        raise Malformed("timecode tracks")
    out["timecode"] = None
    if clock:
        flags, _, _, fps = struct.unpack(">IIIB", clock[0].entry[20:33])
        ((off, size, *_),) = clock[0].samples().tuples()
        out["timecode"] = {"start": int.from_bytes(data[off : off + size], "big"), "fps": fps, "drop": flags & 1}
    return out


# ---- writing ------------------------------------------------------------------------------------------------


def atom(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind.encode("latin-1")) + body


def full(kind: str, *parts: bytes, flags: int = 0) -> bytes:
    return atom(kind, struct.pack(">I", flags), *parts)


def _packed(values: np.ndarray, kind: str = ">u4") -> bytes:
    """Numbers as big-endian bytes."""
    if values.size and (values.min() < 0 or (kind == ">u4" and values.max() > UINT32)):
        raise struct.error("a number out of its range")
    return values.astype(kind).tobytes()


def counted(kind: str, values: np.ndarray | list, form: str = ">u4") -> bytes:
    """A full atom with the number of its entries (rows) in front."""
    values = np.asarray(values, np.int64)
    return full(kind, struct.pack(">I", len(values)), _packed(values, form))


def run_lengths(values: np.ndarray) -> np.ndarray:
    """(length, value) of each run of equal values."""
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1))
    return np.stack([np.diff(starts, append=len(values)), values[starts]], axis=1)


@dataclass
class Frames:
    """Samples to be written, by columns; `data` are their bytes, one after another."""

    size: np.ndarray
    dur: np.ndarray
    sync: np.ndarray
    data: bytes | memoryview

    def __len__(self) -> int:
        return len(self.size)


def frames_of(samples: Frames | list[dict]) -> Frames:
    """By columns, of a list of {data, dur, sync} (sync may be missing)."""
    if isinstance(samples, Frames):
        return samples
    size, dur = (np.array([f(s) for s in samples], np.int64) for f in (lambda s: len(s["data"]), lambda s: s["dur"]))
    return Frames(size, dur, np.array([bool(s.get("sync")) for s in samples], bool), b"".join(s["data"] for s in samples))


def _config_atom(c: dict) -> bytes:
    names = ("profile", "pixel_format", "bit_depth", "qmatrix_id", "qp_base", "alpha_mode", "alpha_bit_depth", "flags", "color_primaries", "color_transfer", "color_matrix", "chroma_siting")
    body = b"TPCC\0\1" + bytes(c.get(n, 0) for n in names) + struct.pack(">HHH", c.get("sar_num", 0), c.get("sar_den", 0), 0)
    return atom("tpcC", body, struct.pack(">I", zlib.crc32(body)))


def _meta_atoms(m: dict, frames: int) -> bytes:
    out = b""
    if b := m.get("budget"):
        body = b"TPCB\0\1" + struct.pack(">BBHHHHI", b["alpha_mode"], b["alpha_bit_depth"], b["target_bp"], min(b["actual_bp"], 65535), b["max_error"], b["flags"] | 8 * (b["actual_bp"] > 65535), frames)
        out += atom("tpcB", body, struct.pack(">I", zlib.crc32(body)))
    if m.get("tier") or m.get("vendor") or m.get("label"):
        vendor, label = m.get("vendor", "").encode(), m.get("label", "").encode()
        if len(vendor) > 15 or len(label) > 63 or not 0 <= m.get("tier", 0) <= 8:
            raise Malformed("metadata")
        body = b"TPCD\0\1" + struct.pack(">BBHH", m.get("tier", 0), 0, len(vendor), len(label)) + vendor + label
        out += atom("tpcD", body, struct.pack(">I", zlib.crc32(body)))
    if m.get("raw"):
        out += atom("trwm", m["raw"])
    return out


def _video_entry(m: dict, frames: int) -> bytes:
    c = m["config"]
    head = struct.pack(">6xH16xHHIIIH32sHh", 1, m["width"], m["height"], 0x480000, 0x480000, 0, 1, b"", 24, -1)
    colr = atom("colr", struct.pack(">4sHHH", b"nclc", c.get("color_primaries", 1), c.get("color_transfer", 1), c.get("color_matrix", 1)))
    sar = (c.get("sar_num", 0), c.get("sar_den", 0))
    pasp = atom("pasp", struct.pack(">II", *sar)) if sar not in ((0, 0), (1, 1)) else b""
    return atom(MAGIC, head, colr, pasp, _config_atom(c), _meta_atoms(m, frames))


def _audio_entry(a: dict) -> bytes:
    wide = a["rate"] > 65535
    size = a.get("bits", 16) // 8 * a["channels"]
    chan = full("chan", struct.pack(">III", LAYOUT_TAGS[a["channels"]], 0, 0))
    if wide:
        head = struct.pack(">6xHHHIHHhHII", 1, 2, 0, 0, 3, 16, -2, 0, 0x10000, 72) + struct.pack(">dIIIIII", a["rate"], a["channels"], 0x7F000000, a.get("bits", 16), 14, size, 1)
        return atom("lpcm", head, chan)
    head = struct.pack(">6xHHHIHHHHI", 1, 0, 0, 0, a["channels"], a.get("bits", 16), 0, 0, a["rate"] << 16)
    return atom(a["codec"], head, chan)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _track(number: int, kind: str, timescale: int, duration: int, movie_duration: int, entry: bytes, tables: bytes, size: tuple[int, int] = (0, 0), extra: bytes = b"", edit: bytes = b"") -> bytes:
    audio = kind == "soun"
    tkhd = full("tkhd", struct.pack(">IIIII8xHHH2x", 0, 0, number, 0, movie_duration, 0, 0, 0x100 if audio else 0), _MATRIX, struct.pack(">II", size[0] << 16, size[1] << 16), flags=7)
    mdhd = full("mdhd", struct.pack(">IIIIHH", 0, 0, timescale, duration, 0, 0))
    head = {"vide": full("vmhd", bytes(8), flags=1), "soun": full("smhd", bytes(4)), "tmcd": atom("gmhd", full("gmin", bytes(12)))}[kind]
    hdlr = lambda t, k: full("hdlr", struct.pack(">4s4s12x", t, k.encode()), b"\0")
    dinf = atom("dinf", full("dref", struct.pack(">I", 1), full("url ", flags=1)))
    minf = atom("minf", head, hdlr(b"dhlr", "alis"), dinf, atom("stbl", full("stsd", struct.pack(">I", 1), entry), tables))
    return atom("trak", tkhd, edit, atom("mdia", mdhd, hdlr(b"mhlr", kind), minf), extra)


def _offsets(offsets: np.ndarray | list[int]) -> bytes:
    """32 bits each, or 64 if any needs them."""
    offsets = np.asarray(offsets, np.int64)
    wide = (offsets > UINT32).any()
    return counted("co64" if wide else "stco", offsets, ">u8" if wide else ">u4")


def _sample_tables(f: Frames, offsets: np.ndarray, sync: bool) -> bytes:
    out = counted("stts", run_lengths(f.dur))
    if sync:
        out += counted("stss", np.flatnonzero(f.sync) + 1)
    out += counted("stsc", [(1, 1, 1)] if len(f) else [])
    return out + full("stsz", struct.pack(">II", 0, len(f)), _packed(f.size)) + _offsets(offsets)


FTYP = atom("ftyp", struct.pack(">4sI4s", b"qt  ", 0x200, b"qt  "))


def _moov(m: dict, first: int) -> bytes:
    """The index, for data that begins at `first`: video samples, audio chunks track by track, the timecode."""
    f = frames_of(m["samples"])
    total, at = int(f.dur.sum()), first + int(f.size.sum())
    movie = -(-total * 1000 // m["timescale"])
    tracks = [_track(1, "vide", m["timescale"], total, movie, _video_entry(m, len(f)), _sample_tables(f, first + np.cumsum(f.size) - f.size, True), (m["width"], m["height"]))]
    for i, a in enumerate(m.get("audio") or [], 2):
        c = frames_of(a["chunks"])
        places, dur = at + np.cumsum(c.size) - c.size, int(c.dur.sum())
        at += int(c.size.sum())
        edit = atom("edts", full("elst", struct.pack(">IIiI", 1, -(-dur * 1000 // a["rate"]), a["priming"], 0x10000))) if a.get("priming") else b""
        tracks.append(_track(i, "soun", a["rate"], dur, -(-dur * 1000 // a["rate"]), _audio_entry(a), _sample_tables(c, places, False), edit=edit))
    if t := m.get("timecode"):
        step, scale = (1001, t["fps"] * 1000) if t["drop"] else (512, t["fps"] * 512)
        entry = atom("tmcd", struct.pack(">6xHIIIIB3x", 1, 0, t["drop"], scale, step, t["fps"]))
        n = max(1, len(f))
        tables = counted("stts", [(1, n * step)]) + counted("stsc", [(1, 1, 1)]) + full("stsz", struct.pack(">II", 4, 1)) + _offsets([at])
        tracks.append(_track(len(tracks) + 1, "tmcd", scale, n * step, movie, entry, tables))
    mvhd = full("mvhd", struct.pack(">IIIIIH10x", 0, 0, 1000, movie, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", len(tracks) + 1))
    return atom("moov", mvhd, *tracks)


def _media(m: dict) -> bytes:
    parts = [frames_of(m["samples"]).data, *[frames_of(a["chunks"]).data for a in m.get("audio") or []]]
    if t := m.get("timecode"):
        parts.append(struct.pack(">I", t["start"]))
    return b"".join([struct.pack(">I4sQ", 1, b"mdat", sum(map(len, parts)) + 16), *parts])


def write(m: dict, faststart: bool = False) -> bytes:
    """The file of a movie: samples ({data, dur, sync}, or Frames), timescale, width, height, config, and audio, timecode, tier,
    vendor, label, budget, raw where there are any. The same movie always gives the same bytes."""
    m = {**m, "samples": frames_of(m["samples"]), "audio": [{**a, "chunks": frames_of(a["chunks"])} for a in m.get("audio") or []]}
    media = _media(m)
    if not faststart:
        return b"".join([FTYP, media, _moov(m, len(FTYP) + 16)])
    index = _moov(m, 0)
    while True:  # offsets that need 64 bits make the index longer, which moves the data
        moved = _moov(m, len(FTYP) + len(index) + 16)
        if len(moved) == len(index):
            return FTYP + moved + media
        index = moved


def rewritten(data: bytes) -> bytes:
    """The file with its index before the data; empty if it stands there already."""
    top = {p: (at, head, size) for p, at, head, size in atoms(data) if "/" not in p}
    (index, ihead, isize), (media, mhead, msize) = top["moov"], top["mdat"]
    if index < media:
        return b""
    moov, body = data[index : index + isize], data[media : media + msize]
    grown = 0
    while True:
        made = _shifted(moov, len(FTYP) + isize + grown - media)
        if len(made) == isize + grown:
            return data[: len(FTYP)] + made + body
        grown = len(made) - isize


def _shifted(moov: bytes, by: int) -> bytes:
    """The index with all offsets moved; each track's table is as wide as its offsets then need."""

    def rebuilt(lo: int, hi: int) -> bytes:
        out = b""
        while lo < hi:
            size, kind = int.from_bytes(moov[lo : lo + 4], "big"), moov[lo + 4 : lo + 8].decode("latin-1")
            if kind in ("stco", "co64"):
                out += _offsets(_table(moov[lo + 8 : lo + size], 1, ">u4" if kind == "stco" else ">u8")[:, 0] + by)
            elif kind in CONTAINERS:
                out += atom(kind, rebuilt(lo + 8, lo + size))
            else:
                out += moov[lo : lo + size]
            lo += size
        return out

    return rebuilt(0, len(moov))


# ---- columns ------------------------------------------------------------------------------------------------

SAMPLES = "array<struct<off:bigint,size:bigint,pts:bigint,dur:bigint,sync:boolean>>"
INDEX = (
    f"movie bigint, status int, timescale bigint, width int, height int, faststart boolean, tier int, vendor string, label string, profile int, bit_depth int, target_bp int, actual_bp int, max_error int, "
    f"tc_start bigint, tc_fps int, tc_drop int, samples {SAMPLES}, audio array<struct<codec:string,rate:bigint,channels:int,priming:bigint,chunks:{SAMPLES}>>"
)


def _together(rows: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Small batches put together, up to about so many bytes."""
    held, size = [], 0
    for batch in rows:
        held.append(batch)
        size += batch.nbytes
        if size >= most or len(held) == 4096:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(movie, content) of batches of both, one file at a time; no bytes for no file."""
    for batch in batches:
        for movie, content in zip(batch.column(0), batch.column(1)):
            yield movie.as_py(), content.as_py() or b""


def _structs(p: Placed, kind: pa.StructType) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x) for x in (p.off, p.size, p.pts, p.dur, p.sync)], fields=[kind.field(i) for i in range(5)])


def _lists(tables: list[Placed], kind: pa.ListType) -> pa.ListArray:
    """A list of structs for each sample table."""
    ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([_structs(p, kind.value_type) for p in tables] or [pa.array([], kind.value_type)]), type=kind)


def _index_row(movie: int, content: bytes, schema: pa.Schema) -> pa.RecordBatch:
    try:
        m = columns_of(content)
    except (Malformed, struct.error, UnicodeDecodeError, ValueError):
        return pa.RecordBatch.from_pylist([{"movie": movie, "status": -9}], schema)
    b, t = m["budget"] or {}, m["timecode"] or {}
    row = {
        "movie": movie, "status": 0, **{k: m[k] for k in ("timescale", "width", "height", "faststart", "tier", "vendor", "label")},
        "profile": m["config"]["profile"], "bit_depth": m["config"]["bit_depth"], "target_bp": b.get("target_bp"), "actual_bp": b.get("actual_bp"), "max_error": b.get("max_error"),
        "tc_start": t.get("start"), "tc_fps": t.get("fps"), "tc_drop": t.get("drop"),
    }
    kind = schema.field("audio").type
    of = kind.value_type
    tracks = [pa.array([a[n] for a in m["audio"]], of.field(n).type) for n in ("codec", "rate", "channels", "priming")]
    audio = pa.StructArray.from_arrays([*tracks, _lists([a["chunks"] for a in m["audio"]], of.field("chunks").type)], fields=[of.field(i) for i in range(of.num_fields)])
    made = {"samples": _lists([m["samples"]], schema.field("samples").type), "audio": pa.ListArray.from_arrays(pa.array([0, len(audio)], pa.int32()), audio, type=kind)}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array([row[f.name]], f.type) for f in schema], schema=schema)


def index_of(df: DataFrame) -> DataFrame:
    """The index of each file of df(movie, content); status -9 and nulls where it breaks the format."""
    arrow = to_arrow_schema(StructType.fromDDL(INDEX))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(_index_row(movie, content, arrow) for movie, content in _each(batches))

    return df.select("movie", "content").mapInArrow(work, INDEX)


def atoms_of(df: DataFrame) -> DataFrame:
    """(movie, n, path, off, size) of all atoms of df(movie, content)."""

    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())

    def made(movie: int, content: bytes) -> pa.RecordBatch:
        rows = [(movie, n, p, at, size) for n, (p, at, _, size) in enumerate(atoms(content))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], ["movie", "n", "path", "off", "size"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(made(movie, content) for movie, content in _each(batches))

    return df.select("movie", "content").mapInArrow(work, "movie bigint, n int, path string, off bigint, size bigint")


def _file(movie: int, content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([movie], pa.int64()), pa.array([content], pa.binary())], ["movie", "content"])


def _frames(samples: pa.StructArray) -> Frames:
    """One movie's samples where they stand in Arrow's buffers: their bytes are not copied."""
    data, dur, sync = (samples.field(n) for n in ("data", "dur", "sync"))
    if samples.null_count or data.null_count or dur.null_count:
        raise Malformed("a sample without bytes or duration")
    _, ends, raw = data.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int32)
    body = memoryview(raw)[at[0] : at[-1]] if raw is not None else b""
    return Frames(np.diff(at).astype(np.int64), dur.to_numpy(zero_copy_only=False).astype(np.int64), sync.fill_null(False).to_numpy(zero_copy_only=False).astype(bool), body)


def written(df: DataFrame, faststart: bool = False) -> DataFrame:
    """(movie, content) of df(movie, samples: array<struct<data, dur, sync>>, timescale, width, height, config: map,
    meta: struct of tier, vendor, label, target_bp, actual_bp, max_error, tc_start, tc_fps, tc_drop, audio)."""

    def made(r: dict, samples: Frames) -> pa.RecordBatch:
        m, config = r["meta"] or {}, dict(r["config"])
        movie = {"samples": samples, "timescale": r["timescale"], "width": r["width"], "height": r["height"], "config": config, "audio": m.get("audio")}
        movie |= {k: m[k] for k in ("tier", "vendor", "label") if m.get(k)}
        if m.get("target_bp") is not None:
            movie["budget"] = {"alpha_mode": config.get("alpha_mode", 0), "alpha_bit_depth": config.get("alpha_bit_depth", 0), "target_bp": m["target_bp"], "actual_bp": m["actual_bp"], "max_error": m["max_error"], "flags": 0}
        if m.get("tc_start") is not None:
            movie["timecode"] = {"start": m["tc_start"], "fps": m["tc_fps"], "drop": m["tc_drop"]}
        return _file(r["movie"], write(movie, faststart))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, rest = batch.column("samples"), batch.drop_columns(["samples"])
            for i in range(len(batch)):
                (r,) = rest.slice(i, 1).to_pylist()
                yield made(r, _frames(samples[i].values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(each(batches))

    return df.select("movie", "samples", "timescale", "width", "height", "config", "meta").mapInArrow(work, "movie bigint, content binary")


def faststart(df: DataFrame) -> DataFrame:
    """(movie, content) with the index before the data; empty content where it stood there already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(_file(movie, rewritten(content)) for movie, content in _each(batches))

    return df.select("movie", "content").mapInArrow(work, "movie bigint, content binary")


def sample_bytes(files: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(movie, idx, faststart, first, off, size, pts, dur, sync, data) of the samples lo up to hi (exclusive) of
    df(movie, content), `first` being the first sample's offset. Each file is read and cut where it stands; nothing is
    joined. Files that break the format have no rows."""
    schema = "movie bigint, idx int, faststart boolean, first bigint, off bigint, size bigint, pts bigint, dur bigint, sync boolean, data binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def cut(movie: int, content: bytes) -> Iterator[pa.RecordBatch]:
        try:
            m = columns_of(content)
        except (Malformed, struct.error, UnicodeDecodeError, ValueError):
            return
        p = m["samples"]
        most, end = 4096, len(p) if hi is None else min(hi, len(p))
        for a in range(lo, end, most):
            at = slice(a, min(a + most, end))
            n = at.stop - a
            same = [pa.array([x] * n, t) for x, t in ((m["faststart"], pa.bool_()), (int(p.off[0]), pa.int64()))]
            data = pa.array([content[o : o + k] for o, k in zip(p.off[at].tolist(), p.size[at].tolist())], pa.binary())
            columns = [pa.array(x[at]) for x in (p.off, p.size, p.pts, p.dur, p.sync)]
            yield pa.RecordBatch.from_arrays([pa.array([movie] * n, pa.int64()), pa.array(np.arange(a, at.stop, dtype=np.int32)), *same, *columns, data], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _together(batch for movie, content in _each(batches) for batch in cut(movie, content))

    return files.select("movie", "content").mapInArrow(work, schema)


def packets(files: DataFrame, lo: int = 0, hi: int | None = None) -> DataFrame:
    """(movie, idx, pts, dur, sync, data) of the samples lo up to hi (exclusive) of df(movie, content)."""
    return sample_bytes(files, lo, hi).select("movie", "idx", "pts", "dur", "sync", "data")


# ---- sample tables as DataFrames ----------------------------------------------------------------------------


def durations(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, pts, dur) of runs(by, run, n, dur), run counting up: each run is expanded where it stands, so that
    only runs are put in order."""
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("_i", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("_p", F.coalesce(F.sum(F.col("n") * F.col("dur")).over(w), F.lit(0)))
    each = starts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)))
    return each.select(*by, (F.col("_i") + F.col("_k")).cast("bigint").alias("idx"), (F.col("_p") + F.col("_k") * F.col("dur")).cast("bigint").alias("pts"), "dur")


def chunk_samples(runs: DataFrame, chunks: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, idx, chunk, off, size): sizes(by, idx, size) laid into chunks(by, chunk, off), chunk from 1, by
    runs(by, first, per): from chunk `first` on, each holds `per` samples."""
    runs_in = Window.partitionBy(*by).orderBy("first")
    to_next = runs.withColumn("_next", F.lead("first").over(runs_in))
    before = F.coalesce(F.sum((F.col("_next") - F.col("first")) * F.col("per")).over(runs_in.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = to_next.select(*by, F.col("first").alias("chunk"), F.lit(None).cast("bigint").alias("off"), F.struct("first", "per", before.alias("i")).alias("_run"))
    # each chunk takes the run that began last: one sort of both, no range join
    both = chunks.select(*by, F.col("chunk"), F.col("off"), F.lit(None).cast(begun.schema["_run"].dataType).alias("_run")).unionByName(begun)
    in_order = Window.partitionBy(*by).orderBy("chunk", F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    each = both.withColumn("_of", F.last("_run", ignorenulls=True).over(in_order)).filter(F.col("_run").isNull() & (F.col("_of.per") > 0))
    start = (F.col("_of.i") + (F.col("chunk") - F.col("_of.first")) * F.col("_of.per")).cast("bigint")
    held = each.select(*by, "chunk", "off", F.explode(F.sequence(start, start + F.col("_of.per") - 1)).alias("idx"))
    # Spark takes what an explode makes to be as small as what it reads; without the hint it would send one side to every task
    placed = held.join(sizes.hint("merge"), [*by, "idx"])
    inside = F.coalesce(F.sum("size").over(Window.partitionBy(*by, "chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select(*by, "idx", "chunk", (F.col("off") + inside).cast("bigint").alias("off"), "size")


def faststart_offsets(samples: DataFrame, by: list[str], index_bytes: Column, order: list[str]) -> DataFrame:
    """(by, order, off, wide): offsets after the index has moved before the data, and whether the table needs 64 bits."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    off = (F.lit(len(FTYP) + 16) + index_bytes + F.coalesce(F.sum("size").over(w), F.lit(0))).cast("bigint")
    moved = samples.withColumn("off", off)
    return moved.withColumn("wide", F.max("off").over(Window.partitionBy(*by)) > UINT32).select(*by, *order, "off", "wide")


def timecode_status(h: Column, m: Column, s: Column, f: Column, fps: Column, drop: Column) -> Column:
    """0, or -1 for a rate or label that does not exist (dropped labels included)."""
    tens = F.when(fps == 60, 4).otherwise(2)
    bad = ~fps.isin(*FPS) | (drop > 1) | ((drop != 0) & ~fps.isin(30, 60)) | (h >= 24) | (m >= 60) | (s >= 60) | (f >= fps) | ((drop != 0) & (s == 0) & (m % 10 != 0) & (f < tens))
    return F.when(bad, -1).otherwise(0).cast("int")


def audio_status(codec: Column, rate: Column, channels: Column, layout: Column, bits: Column, fmt: Column) -> Column:
    """0, or -1 for fields that don't go together: codec 1 (lpcm) or 2 (mp4a), fmt 1 for 32-bit floats."""
    pairs = F.lit(False)
    for c, n in LAYOUTS.items():
        pairs = pairs | ((channels == c) & (layout == n))
    depth = F.when(codec == 1, bits.isin(16, 24, 32)).otherwise(bits.isin(0, 16))
    ok = codec.isin(1, 2) & rate.isin(*RATES) & pairs & fmt.isin(0, 1) & ((fmt == 0) | ((codec == 1) & (bits == 32))) & depth
    return F.when(ok, 0).otherwise(-1).cast("int")
