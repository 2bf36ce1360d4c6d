"""The identity run against a plain-Python one over the same rows, from sightings and vectors to persons by window."""

import math
import os
from collections import defaultdict

import numpy as np
import pytest

from chronoweave.plans import catalogue
from chronoweave.sources import adapters as A

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
P = catalogue.RUN


def unit(v):
    n = float(np.linalg.norm(v))
    return v / n if n > 0 else v


class Known:
    """A gallery as the rules tell it."""

    def __init__(self, hit, new, low):
        self.hit, self.new, self.low, self.shots, self.size = hit, new, low, [], 0

    def see(self, v, ok, auto=True):
        v = unit(v)
        scores = sorted(((float(s @ v), -i, who) for i, (s, who) in enumerate(self.shots)), reverse=True)[: P.top_k]
        best = defaultdict(lambda: [0.0, 0])
        for s, _, who in scores:
            best[who][0] = max(best[who][0], s)
            best[who][1] += s >= P.vote
        order = sorted(best, key=lambda w: (-best[w][0], -best[w][1], w))
        if not order:
            who, score, told = None, 0.0, "new"
        else:
            who = order[0]
            score, votes = best[who]
            told = "hit" if score >= self.hit else "new" if score < self.new else "grey"
            if told == "hit":
                high = sum(best[w][1] for w in order if best[w][0] >= P.vote)
                if high > 0 and votes / high < P.vote_share:
                    told = "grey"
                elif len(order) > 1 and score - best[order[1]][0] < P.margin and votes <= best[order[1]][1]:
                    told = "grey"
        found, enrolled = None, False
        if told == "hit" and not ok and round(score, 4) < self.low:
            told = "grey"
        elif told == "hit":
            found = who
            if ok and sum(w == who for _, w in self.shots) < P.max_shots:
                self.shots.append((v, who))
        elif told == "new" and auto and ok:
            self.size += 1
            found, enrolled = self.size, True
            self.shots.append((v, found))
        return told, found, round(score, 4), enrolled


def apart(a, b):
    return a["last"] < b["first"] or b["last"] < a["first"]


def stitched(ids):
    """Orphans join subjects, then each other."""
    members = {}
    for t in ids:
        if t["vec"] is not None and not t["skipped"] and t["subject"] is not None:
            members.setdefault(t["subject"], []).append(t)
    mean = lambda ts: unit(np.mean([t["vec"] for t in ts], axis=0))
    left = []
    for t in [t for t in ids if t["vec"] is not None and not t["skipped"] and t["subject"] is None]:
        free = [(float(unit(t["vec"]) @ mean(ms)), -i, s) for i, (s, ms) in enumerate(members.items()) if all(apart(t, m) for m in ms)]
        if free and max(free)[0] >= (P.stitch if t["ok"] else max(P.stitch, P.stitch_local)):
            score, _, s = max(free)
            members[s].append(t)
            t.update(subject=s, decision="stitched", reused=True, stitch_score=round(score, 4))
        else:
            left.append(t)
    clusters = []
    for t in left:
        free = [(float(unit(t["vec"]) @ (mean(c["ts"]))), -i) for i, c in enumerate(clusters) if all(apart(t, m) for m in c["ts"])]
        if free and max(free)[0] >= max(P.stitch, P.stitch_local):
            score, i = max(free)
            clusters[-i]["ts"].append(t)
            clusters[-i]["best"] = max(score, clusters[-i]["best"])
        else:
            clusters.append({"ts": [t], "best": -9.0})
    number = max([t["subject"] for t in ids if t["subject"] is not None], default=0)
    by_track = {t["track"]: t for t in ids}
    for c in sorted(clusters, key=lambda c: by_track[min(t["track"] for t in c["ts"])]["first"]):
        number += 1
        for t in c["ts"]:
            many = len(c["ts"]) > 1
            t.update(subject=number, decision="local_stitched" if many else "local", local=True, cross_merged=many, stitch_score=round(c["best"], 4) if many else None)


def merged(ids):
    groups = {t["track"]: {t["track"]} for t in ids}
    by = defaultdict(list)
    for t in ids:
        f, g = t["face"], t["gait"]
        keys = {"body": t["body"], "face": f["local"] if f["strict"] else None, "gait": g["local"] if g and g["decision"] == "hit" else None}
        for route, local in keys.items():
            if local is not None:
                by[route, local].append(t["track"])
    for (_, _), ts in by.items():
        for other in ts[1:]:
            both = groups[ts[0]] | groups[other]
            for x in both:
                groups[x] = both
    number, done, known = max([t["subject"] for t in ids if t["subject"] is not None], default=0), set(), {t["track"]: t for t in ids}
    for t in ids:
        t["routes"] = {}
        group = groups[t["track"]]
        if len(group) > 1 and min(group) not in done:
            done.add(min(group))
            own = [known[x]["subject"] for x in group if known[x]["subject"] is not None]
            if own:
                subject = min(own)
            else:
                number += 1
                subject = number
            routes = sorted({r for (r, _), ts in by.items() if len(ts) > 1 and ts[0] in group})
            for x in group:
                m = known[x]
                m.update(merge_routes=",".join(routes), merge_agree=len(routes))
                if m["subject"] != subject:
                    m.update(cross_merged=True, reused=True, decision=m["decision"] if m["decision"] in ("hit", "stitched") else "merged", subject=subject)
    if len(ids) > 1:
        for t in ids:
            if t["subject"] is not None:
                t["routes"] = {r: t["subject"] for r, on in (("body", t["body"] is not None), ("face", t["face"]["strict"]), ("gait", bool(t["gait"]) and t["gait"]["local"] is not None)) if on}


def split(ids):
    by = {}
    for t in ids:
        if t["subject"] is not None:
            by.setdefault(t["subject"], []).append(t)
    number = max(by, default=0)
    for ts in by.values():
        clusters = []
        for t in sorted(ts, key=lambda t: (t["first"], t["last"])):
            home = next((c for c in clusters if all(apart(t, m) for m in c)), None)
            if home is None:
                clusters.append([t])
            else:
                home.append(t)
        if len(clusters) > 1:
            for i, c in enumerate(clusters):
                number += i > 0
                for t in c:
                    t.update(split=True, reused=False, decision="conflict_split" if t["decision"] == "hit" else t["decision"])
                    if i:
                        t["subject"] = number


def clamp(x):
    return max(0.0, min(1.0, x))


def fused(t):
    f, g = t["face"], t["gait"]
    fs = fw = 0.0
    if f["match_ready"]:
        fw = P.face_weight * (P.quality_floor + (1 - P.quality_floor) * clamp(f["quality"]))
        fs = f["match_score"] if f["match_score"] is not None else f["det"]
        fs = clamp(max(fs, 0.6) if f["matched"] else fs)
    bs = t["score"] or 0.0
    bs = clamp(max(bs, 0.5) if t["decision"] in ("hit", "stitched") else bs)
    cues = {"face": (fs, fw), "body": (bs, P.body_weight), "gait": (clamp(g["score"]), P.gait_weight) if g else (0.0, 0.0)}
    active = [k for k, (s, w) in cues.items() if s > 0 and w > 0]
    c = sum(s * w for s, w in cues.values()) / sum(w for _, w in cues.values())
    agreed = sum(t["subject"] is not None and t["routes"].get(k) == t["subject"] for k in active) >= 2
    c = min(1.0, c + P.agree_bonus) if agreed else c
    top = max(cues, key=lambda k: cues[k][0] * cues[k][1])
    t.update(confidence=round(c, 4), resolved=c >= P.resolve, multi_source=len(active) > 1, agreed=agreed, primary=top if cues[top][0] * cues[top][1] > 0 else None, cues=",".join(active))


def faces_of(spark, found, tracks, vec):
    """Face records by plain rules; candidates and matches of small boxes are the library's, which have tests of their own."""
    from chronoweave.operators import keyframes
    from chronoweave.operators import tracks as T

    sightings = A.sightings(spark, SF)
    graded = catalogue._graded_faces(sightings)
    chosen = keyframes.spaced_candidates(sightings.where("track % 7 <> 0"), ["session", "track"], "quality", P.with_(candidates=2)).collect()
    near = {(r["session"], r["frame"], r["track"]): r for r in T.associate(graded, sightings, P).collect()}
    graded = {(r["session"], r["frame"], r["face"]): r for r in graded.collect()}
    tries = defaultdict(list)
    for r in sorted(chosen, key=lambda r: r["nth"]):
        tries[r["session"], r["track"]].append(r["frame"])
    out = {}
    grade = {"none": 0, "unusable": 1, "recoverable": 2, "direct": 3, "poor": 1, "marginal": 2, "clear": 3}
    galleries = defaultdict(lambda: Known(P.face_hit, P.face_new, P.face_hit))
    for t in tracks:
        key = t["session"], t["track"]
        r = {"status": None, "frame": None, "face": None, "local": None, "matched": False, "match_ready": False, "match_score": None, "error": None, "strict": False, "quality": None, "det": None, "enrolled": False}
        out[key] = r
        if t["skipped"]:
            r["status"] = "track_skipped"
            continue
        frames = tries.get(key) or [t["best_frame"]]
        options = []
        for frame in frames:
            m = near.get((t["session"], frame, t["track"]))
            if frame % 7 == 0:
                r["error"] = f"detect: {frame}"
            elif m is not None:
                g = graded[t["session"], frame, m["face"]]
                options.append((grade[g["eligibility"]], grade[g["category"]], g["quality"], m["score"], g["det"], -frame, g))
        if not options:
            r["status"] = "detector_error" if r["error"] else "not_detected"
            continue
        *_, g = max(options, key=lambda o: o[:6])
        frame = g["frame"]
        r.update(frame=frame, face=g["face"], quality=g["quality"], det=g["det"], error=None)
        if frame % 11 == 0:
            r.update(status="face_frame_unavailable", error=f"open: {frame}")
            continue
        own, body = found[t["session"], frame, t["track"]], found[t["session"], t["best_frame"], t["track"]]
        if frame == t["best_frame"]:
            fits = "same_frame"
        elif body["k"] % 10 == 9 or own["k"] % 10 == 9:
            fits = None
        else:
            a, b = (vec(d["user"], d["track"] * 37 + d["frame"], d["k"] % 10 * 0.12) for d in (own, body))
            fits = "passed" if float(unit(a) @ unit(b)) >= 0.5 else None
        if not fits:
            r["status"] = "track_consistency_failed"
            continue
        if frame % 13 == 0:
            r.update(status="face_finalize_error", error=f"finalize: {frame}")
            continue
        r["status"] = "observed"
        source = "original" if g["eligibility"] == "direct" else "superres" if g["eligibility"] == "recoverable" and g["restored"] else "none"
        of = found.get((t["session"], frame, g["face"]))
        r["match_ready"] = source != "none" and of is not None and of["k"] % 12 != 5
        if r["match_ready"]:
            good = source == "original" and g["category"] == "clear"
            told, who, score, enrolled = galleries[t["session"]].see(vec(of["user"] * 3 + 1, of["track"] * 41 + frame, of["k"] % 8 * 0.2), good, good)
            r.update(local=who, matched=told == "hit", match_score=score, enrolled=enrolled)
            r["strict"] = r["matched"] and g["eligibility"] == "direct" and g["category"] == "clear" and who is not None
    return out


@pytest.fixture(scope="module")
def run(spark):
    rows = [r.asDict() for r in A.sightings(spark, SF).collect()]
    emb = np.array([r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], dtype=np.float64)
    vec = lambda own, other, w: emb[own % len(emb)] + w * emb[other % len(emb)]
    found = {(r["session"], r["frame"], r["track"]): r for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["session"], r["track"]].append(r)
    tracks = []
    for (session, track), ds in by.items():
        area = lambda d: (d["x2"] - d["x1"]) * (d["y2"] - d["y1"])
        best = max(ds, key=lambda d: (d["quality"] * min(1.0, area(d) / P.reference_area), -d["frame"]))
        tracks.append({
            "session": session, "track": track, "first": min(d["frame"] for d in ds), "last": max(d["frame"] for d in ds), "best_frame": best["frame"], "box": [best[c] for c in ("x1", "y1", "x2", "y2")], "skipped": len(ds) < P.track_min_frames, "ok": best["k"] % 4 != 0,
            "vec": vec(best["user"], track * 37 + best["frame"], best["k"] % 10 * 0.12), "user": best["user"], "n": len(ds), "k": max(d["k"] for d in ds), "body": None, "subject": None, "decision": None, "score": None, "reused": False, "local": False, "cross_merged": False, "split": False, "stitch_score": None, "merge_routes": "", "merge_agree": 0,
        })
    tracks.sort(key=lambda t: (t["session"], t["first"], t["track"]))
    sessions = defaultdict(list)
    for t in tracks:
        sessions[t["session"]].append(t)
    faces = faces_of(spark, found, tracks, vec)
    hits = []
    for session, ids in sessions.items():
        bodies, gaits = Known(P.hit, P.new, P.low_quality_hit), Known(P.hit, P.new, P.low_quality_hit)
        for t in ids:
            t["face"], t["gait"] = faces[session, t["track"]], None
            if not t["skipped"]:
                t["decision"], t["body"], t["score"], _ = bodies.see(t["vec"], t["ok"])
                t["subject"], t["reused"] = t["body"], t["decision"] == "hit"
        stitched(ids)
        hits += [(session, t["first"], f"identity_hit:主体#{t['subject']}") for t in ids if t["reused"] and t["subject"] is not None]
        for t in ids:
            if not t["skipped"] and t["n"] >= P.gait_frames:
                told, who, score, _ = gaits.see(vec(t["user"] * 5 + 2, t["track"] * 43, t["k"] % 7 * 0.2), True)
                t["gait"] = {"decision": told, "local": who, "score": score}
        merged(ids)
        split(ids)
        for t in ids:
            fused(t)
    return {"rows": rows, "tracks": {(t["session"], t["track"]): t for t in tracks}, "faces": faces, "hits": hits}


def same(a, b):
    return a == b if a is None or b is None or not isinstance(a, float) else math.isclose(a, b, abs_tol=1.5e-4)


def test_identities(spark, run):
    got = catalogue.QUERIES["q90_identity_run"](spark, SF).collect()
    assert len(got) == len(run["tracks"])
    for r in got:
        t = run["tracks"][r["session"], r["track"]]
        for c in ("skipped", "body", "subject", "decision", "score", "stitch_score", "reused", "local", "cross_merged", "split", "merge_routes", "merge_agree", "confidence", "resolved", "multi_source", "agreed", "primary", "cues"):
            assert same(r[c], t[c]), (c, r, t)
        assert [r[f"route_{k}"] for k in ("body", "face", "gait")] == [t["routes"].get(k) for k in ("body", "face", "gait")], (r, t)
    decisions = {r["decision"] for r in got}
    assert {"hit", "new", "stitched", "merged", "conflict_split", None} <= decisions and any(r["face_matched"] for r in got)


def test_face_records(spark, run):
    got = {(r["session"], r["track"]): r for r in catalogue.QUERIES["q92_run_faces"](spark, SF).collect()}
    assert got.keys() == run["faces"].keys()
    for key, f in run["faces"].items():
        for c in ("status", "frame", "face", "error", "match_ready", "matched", "local", "match_score", "enrolled"):
            assert same(got[key][c], f[c]), (c, got[key], f)
    assert {"detector_error", "face_frame_unavailable", "face_finalize_error", "track_consistency_failed", "track_skipped", "observed"} <= {f["status"] for f in run["faces"].values()}


def test_persons_by_window(spark, run):
    sessions, people = defaultdict(lambda: defaultdict(list)), {}
    for r in run["rows"]:
        sessions[r["session"]][r["frame"]].append(r)
    for session, frames in sessions.items():
        cuts, window, gap = [], [], 0
        for f in range(min(frames), max(frames) + 1):
            if f in frames:
                window.append(f)
                gap = 0
                if len(window) >= catalogue.CAP:
                    cuts.append(window)
                    window = []
            elif window:
                gap += 1
                if gap >= catalogue.QUIET:
                    cuts.append(window)
                    window, gap = [], 0
                else:
                    window.append(f)
        for window in [*cuts, window] if window else cuts:
            groups = defaultdict(list)
            inside = [r for f in window for r in sorted(frames.get(f, []), key=lambda r: r["track"])]
            for track in sorted({r["track"] for r in inside}):
                t = run["tracks"][session, track]
                groups[f"subject:{t['subject']}" if t["subject"] is not None else f"track:{track}"].append(t)
            for person, ts in groups.items():
                rep = min(ts, key=lambda t: (-(t["score"] or 0.0), t["track"]))
                last = [r for r in inside if r["track"] == rep["track"] and r["frame"] == window[-1]]
                one, local, cut = len(ts) == 1, any(t["local"] for t in ts), any(t["split"] for t in ts)
                best = max(t["score"] or 0.0 for t in ts)
                people[session, window[0], person] = {
                    "track": rep["track"], "tracks": ",".join(str(t["track"]) for t in ts), "decision": rep["decision"] if one else "local_stitched" if local else "conflict_split" if cut else "hit",
                    "reused": rep["reused"] if one else not (local or cut), "score": rep["score"] if one else best if best > 0 else None, "fused": max(t["confidence"] for t in ts),
                    "box": [last[0][c] for c in ("x1", "y1", "x2", "y2")] if last else rep["box"], "n": sum(r["track"] in {t["track"] for t in ts} for r in inside),
                    "kind": None if one else "本视频本地subject" if local else "时间冲突拆分subject" if cut else "同一人", "routes": ",".join(sorted({r for t in ts for r in t["merge_routes"].split(",") if r})),
                }
    got = {(r["session"], r["window"], r["person"]): r for r in catalogue.QUERIES["q91_run_persons"](spark, SF).collect()}
    assert got.keys() == people.keys()
    for key, want in people.items():
        r = got[key]
        for c in ("track", "tracks", "decision", "reused", "score", "fused"):
            assert same(r[c], want[c]), (c, r, want)
        assert [float(x) for x in r["box"].split(",")] == want["box"] and r["merge_routes"] == want["routes"] and len(r["path"].split(";")) == want["n"]
        assert (r["attributes"] == "") == (want["kind"] is None) and (want["kind"] or "") in r["attributes"]


def test_events_of_known_persons(spark, run):
    got = sorted(tuple(r) for r in catalogue.QUERIES["q93_run_events"](spark, SF).collect() if r["event"].startswith("identity_hit"))
    assert got == sorted(run["hits"]) and got
