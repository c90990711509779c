"""Per-frame state machines on Structured Streaming.

State is kept for packs of up to ``2**PACK`` videos with neighbouring ids, as a call and a state row of
their own cost far more than the few frames a batch brings of one video; a pack's videos are scored at once. A
micro-batch brings a bounded number of rows of a video (limit it at the source, e.g.
``maxFilesPerTrigger``), so one busy video is a bounded group per batch. Frames of a stream must not go
backwards between batches; a frame that was already passed is ignored, which is also the duplicate rule
(first one wins).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelane.operators.confidence import ALPHA, DRIFT_NORMALIZER, WEIGHTS

CONFIDENCE_OUT = (
    "video_id long, frame_index int, drift double, distribution double, token double, blended double, confidence double, low_streak int, "
    "x double, y double, w double, h double, held boolean"
)
#: Bits of a video id that tell the videos of one pack apart.
PACK = 6
BOX, DISTRIBUTION, TOKEN = 0, 1, 2
_NUMBERS = ("x", "y", "w", "h", "is_fallback", "value")
#: What is kept of a scored video, and a row that waits for the other streams.
_SEEN = np.dtype([("video", "<i8"), ("frame", "<i4"), ("streak", "<i4"), ("conf", "<f8"), ("anchor", "<f8", 4), ("box", "<f8", 4)])
_ROW = np.dtype([("video", "<i8"), ("frame", "<i4"), ("kind", "<i4"), ("pos", "<i8"), ("numbers", "<f8", len(_NUMBERS))])
_CHOSEN = np.dtype([("video", "<i8"), ("frame", "<i4"), ("track", "<i8"), ("box", "<f8", 4)])
CONFIDENCE_STATE = "seen binary, waiting binary"


def packed(rows: DataFrame):
    """Rows grouped by pack of videos."""
    return rows.withColumn("_pack", F.shiftright("video_id", PACK)).groupBy("_pack")


def _records(part: pd.DataFrame, form: np.dtype, **cols) -> np.ndarray:
    """Columns as records; a null video is a pack of its own and counts as 0, a null position comes last."""
    out = np.zeros(len(part), form)
    out["video"] = part["video_id"].fillna(0)
    out["frame"] = part["frame_index"]
    for name, values in cols.items():
        out[name] = values
    return out


def _passed(known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a row's frame was already passed, by what is known of its video."""
    at = np.searchsorted(known["video"], rows["video"])
    inside = np.minimum(at, max(len(known) - 1, 0))
    return (known["video"][inside] == rows["video"]) & (rows["frame"] <= known["frame"][inside]) if len(known) else np.zeros(len(rows), bool)


def _merged(known: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Both by video; new records replace known ones."""
    both = np.concatenate([new, known])
    return both[np.unique(both["video"], return_index=True)[1]]


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where sorted columns change."""
    change = np.ones(len(cols[0]), bool)
    change[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(change)


def _ids(key: tuple, video: np.ndarray) -> np.ndarray:
    return np.full(len(video), None) if pd.isna(key[0]) else video


def _blend(boxes: np.ndarray, anchor: np.ndarray, distribution: np.ndarray | None = None, token: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Drift and blended confidence of boxes (rows of x, y, w, h), each beside its anchor. Signals that are NaN drop out."""
    x, y, w, h = boxes.T
    ax, ay, aw, ah = anchor.T
    reach = np.maximum(np.hypot(aw, ah), 1e-6) * DRIFT_NORMALIZER
    drift = np.maximum(0.0, 1.0 - np.hypot(x + w / 2 - ax - aw / 2, y + h / 2 - ay - ah / 2) / reach)
    logit = WEIGHTS["drift"] * drift
    for name, signal in (("distribution", distribution), ("token", token)):
        if signal is not None:
            logit = logit + WEIGHTS[name] * np.nan_to_num(np.clip(signal, 0.0, 1.0), nan=0.0)
    return drift, 1.0 / (1.0 + np.exp(-logit))


def preview(
    pdf: pd.DataFrame, anchor: tuple, prev: float | None, alpha: float = ALPHA, distribution: np.ndarray | None = None, token: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Drift, blended and smoothed confidence of one video's frames in order; changes nothing."""
    drift, blended = _blend(pdf[list("xywh")].to_numpy(float), np.array(anchor, float), distribution, token)
    return drift, blended, _smooth(blended, np.zeros(1, int), np.array([np.nan if prev is None else prev], float), np.array([prev is not None]), alpha)


def _smooth(blended: np.ndarray, start: np.ndarray, prev: np.ndarray, seen: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Exponential smoothing of videos that begin at ``start``; those already seen go on from ``prev``."""
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(blended))))
    at = start[seen]
    values, groups = pd.Series(np.insert(blended, at, prev[seen])), np.insert(group, at, np.flatnonzero(seen))
    smooth = values.groupby(groups).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return np.delete(smooth, at + np.arange(len(at)))


def _streaks(low: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Length of the run of low frames that ends at each frame; ``start``: first frame of the frame's video."""
    i = np.arange(len(low))
    last_ok = np.maximum.accumulate(np.where(~low, i, -1))
    return np.where(low, np.where(last_ok < start, i - start + 1 + before, i - last_ok), 0)


def _firsts(rows: np.ndarray) -> np.ndarray:
    """One row per video, frame and kind, the first by position, in this order."""
    rows = rows[np.lexsort((rows["pos"], rows["kind"], rows["frame"], rows["video"]))]
    return rows[_starts(rows["video"], rows["frame"], rows["kind"])]


def _confidence(threshold: float, kinds: tuple[int, ...]) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else (b"", b"")
        known, waiting = (np.frombuffer(bytes(b), kind) for b, kind in zip(old, (_SEEN, _ROW)))
        for part in batches:  # kept down to one row per video, frame and kind, batch by batch
            part = part[part["frame_index"].notna()]
            part = _records(part, _ROW, kind=part["kind"], pos=part["pos"].fillna(2**62), numbers=part[list(_NUMBERS)].to_numpy(float))
            waiting = _firsts(np.concatenate([waiting, part[~_passed(known, part)]]))
        if not len(waiting):
            return
        at = _starts(waiting["video"], waiting["frame"])
        count = np.diff(np.append(at, len(waiting)))
        short = np.cumsum(count < len(kinds))
        first = _starts(waiting["video"][at])
        before = np.repeat((short - (count < len(kinds)))[first], np.diff(np.append(first, len(at))))
        ready = np.repeat(short == before, count)
        rest, ready = waiting[~ready], waiting[ready]
        if not len(ready):
            state.update((known.tobytes(), rest.tobytes()))
            return
        rows = ready[ready["kind"] == BOX]
        signal = {k: ready["numbers"][ready["kind"] == k, 5] if k in kinds else np.full(len(rows), np.nan) for k in (DISTRIBUTION, TOKEN)}
        start = _starts(rows["video"])
        length = np.diff(np.append(start, len(rows)))
        last = start + length - 1
        now = np.zeros(len(start), _SEEN)
        now["video"], now["conf"], now["anchor"], now["box"] = rows["video"][start], np.nan, rows["numbers"][start, :4], np.nan
        _, mine, theirs = np.intersect1d(now["video"], known["video"], assume_unique=True, return_indices=True)
        now[mine] = known[theirs]
        seen = np.zeros(len(start), bool)
        seen[mine] = True
        each = np.repeat(np.arange(len(start)), length)
        drift, blended = _blend(rows["numbers"][:, :4], now["anchor"][each], signal[DISTRIBUTION], signal[TOKEN])
        conf = _smooth(blended, start, now["conf"], seen)
        streak = _streaks(conf < threshold, start[each], now["streak"][each])
        own = ~(rows["numbers"][:, 4] > 0) & ~np.isnan(rows["numbers"][:, 0])
        known_at = np.maximum.accumulate(np.where(own, np.arange(len(rows)), -1))
        boxes = np.where((known_at >= start[each])[:, None], rows["numbers"][known_at, :4], now["box"][each])
        held = ~own & ~np.isnan(boxes[:, 0])
        now["frame"], now["streak"], now["conf"], now["box"] = rows["frame"][last], streak[last], conf[last], boxes[last]
        state.update((_merged(known, now).tobytes(), rest.tobytes()))
        yield pd.DataFrame(
            {
                "video_id": _ids(key, rows["video"]), "frame_index": rows["frame"], "drift": drift, "distribution": signal[DISTRIBUTION], "token": signal[TOKEN],
                "blended": blended, "confidence": conf, "low_streak": streak, **{c: boxes[:, i] for i, c in enumerate("xywh")}, "held": held,
            }
        )

    return run


def confidence_stream(frames: DataFrame, threshold: float = 0.5, distribution: DataFrame | None = None, token: DataFrame | None = None) -> DataFrame:
    """Smoothed confidence, low-confidence streak and held box for a stream of frames and, if given, streams of signals.

    ``frames``: video_id, frame_index, pos, x, y, w, h, is_fallback; the first box of a video is its anchor. ``distribution``
    and ``token``: video_id, frame_index, pos, value, a row for every frame, null where there is no signal. A frame is
    scored as soon as all streams have brought it; until then its rows wait in the state, so streams may run ahead of each other.
    """
    none = F.lit(None).cast("double")
    parts = [frames.select("video_id", "frame_index", F.lit(BOX).alias("kind"), F.col("pos").cast("long").alias("pos"), *"xywh", F.col("is_fallback").cast("double").alias("is_fallback"), none.alias("value"))]
    kinds = [BOX]
    for kind, stream in ((DISTRIBUTION, distribution), (TOKEN, token)):
        if stream is not None:
            kinds.append(kind)
            parts.append(stream.select("video_id", "frame_index", F.lit(kind).alias("kind"), F.col("pos").cast("long").alias("pos"), *[none.alias(c) for c in (*"xywh", "is_fallback")], F.col("value").cast("double").alias("value")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return packed(rows).applyInPandasWithState(
        _confidence(threshold, tuple(kinds)), CONFIDENCE_OUT, CONFIDENCE_STATE, "append", GroupStateTimeout.NoTimeout
    )


CHOICE_OUT = "video_id long, frame_index int, track_id long, x double, y double, w double, h double, score double, reason string"
CHOICE_STATE = "chosen binary"


def _overlap(c: np.ndarray, last: np.ndarray) -> np.ndarray:
    """IoU of boxes (rows of x, y, w, h) with one box."""
    iw = np.minimum(c[:, 0] + c[:, 2], last[0] + last[2]) - np.maximum(c[:, 0], last[0])
    ih = np.minimum(c[:, 1] + c[:, 3], last[1] + last[3]) - np.maximum(c[:, 1], last[1])
    inter = np.clip(iw, 0, None) * np.clip(ih, 0, None)
    union = np.clip(c[:, 2], 0, None) * np.clip(c[:, 3], 0, None) + last[2] * last[3] - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


def choose(frame: np.ndarray, ids: np.ndarray, box: np.ndarray, score: np.ndarray, track, last, target) -> tuple[np.ndarray, np.ndarray]:
    """Row chosen for every frame, and why, of candidates sorted by frame.

    The track that is followed (the target's where present) is kept as long as frames show it: such runs of
    frames are taken at once, only a frame that loses the track is looked at on its own.
    """
    frames, start = np.unique(frame, return_index=True)
    stop = np.append(start[1:], len(frame))
    number = np.repeat(np.arange(len(frames)), stop - start)
    found: dict = {}

    def rows_of(t) -> np.ndarray:
        """Per frame the first row of a track, -1 without."""
        if t not in found:
            at = np.full(len(frames), -1)
            hit = np.flatnonzero(ids == t)[::-1]
            at[number[hit]] = hit
            found[t] = at
        return found[t]

    picked, why = np.empty(len(frames), int), np.empty(len(frames), object)
    wanted = rows_of(target) if target is not None else np.full(len(frames), -1)
    i = 0
    while i < len(frames):
        if wanted[i] >= 0:
            gone = np.flatnonzero(wanted[i:] < 0)
            j = i + int(gone[0]) if len(gone) else len(frames)
            picked[i:j], why[i:j] = wanted[i:j], "target"
        elif track is not None and rows_of(track)[i] >= 0:
            gone = np.flatnonzero((rows_of(track)[i:] < 0) | (wanted[i:] >= 0))
            j = i + int(gone[0]) if len(gone) else len(frames)
            picked[i:j], why[i:j] = rows_of(track)[i:j], "sticky"
        else:
            j, part = i + 1, slice(start[i], stop[i])
            over = _overlap(box[part], last) if last is not None else np.zeros(1)
            best, why[i] = (over, "overlap") if over.max() > 0 else (score[part], "score")
            picked[i] = start[i] + int(np.argmax(best))
        track, last, i = ids[picked[j - 1]], box[picked[j - 1]], j
    return picked, why


def _choose(target: int | None, min_score: float) -> Callable:
    kind = np.dtype([*_ROW.descr[:2], ("pos", "<i8"), ("track", "<i8"), ("numbers", "<f8", 5)])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = np.frombuffer(bytes(state.get[0]) if state.exists else b"", _CHOSEN)
        parts = [np.zeros(0, kind)]
        for part in batches:
            part = part[part["frame_index"].notna() & (part["score"].fillna(0.0) >= min_score)]
            part = _records(part, kind, pos=part["pos"].fillna(2**62), track=part["track_id"], numbers=part[[*"xywh", "score"]].to_numpy(float))
            parts.append(part[~_passed(known, part)])
        rows = np.concatenate(parts)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["pos"], rows["frame"], rows["video"]))]
        before = {int(k["video"]): k for k in known}
        start = _starts(rows["video"])
        picked, why, now = [], [], np.zeros(len(start), _CHOSEN)
        for n, (i, j) in enumerate(zip(start, np.append(start[1:], len(rows)))):
            mine = rows[i:j]
            old = before.get(int(mine["video"][0]))
            track, last = (None, None) if old is None else (old["track"], old["box"])
            at, reason = choose(mine["frame"], mine["track"], mine["numbers"][:, :4], np.nan_to_num(mine["numbers"][:, 4], nan=0.0), track, last, target)
            picked.append(i + at)
            why.append(reason)
            end = mine[at[-1]]
            now[n] = (end["video"], end["frame"], end["track"], end["numbers"][:4])
        out = rows[np.concatenate(picked)]
        state.update((_merged(known, now).tobytes(),))
        box = {c: out["numbers"][:, i] for i, c in enumerate([*"xywh", "score"])}
        yield pd.DataFrame({"video_id": _ids(key, out["video"]), "frame_index": out["frame"], "track_id": out["track"], **box, "reason": np.concatenate(why)})

    return run


def candidate_stream(candidates: DataFrame, target: int | None = None, min_score: float = 0.0) -> DataFrame:
    """One box per frame out of several candidates: wanted track, else the current track, else the best overlap with
    the last box, else the best score.

    Columns in: video_id, frame_index, pos, track_id, x, y, w, h, score.
    """
    return packed(candidates).applyInPandasWithState(
        _choose(target, min_score), CHOICE_OUT, CHOICE_STATE, "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, write parquet, and read the result back."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out)
