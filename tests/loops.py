"""Plain sequential forms of the filters: what the DataFrame forms must equal."""

import random

LABELS = ["Fire", "SmokeOnly", "None", None, "skipped", "none", "fire"]


def make_frames(seed=0, lengths=(1, 7, 40, 133), hot=600, weights=(3, 2, 4, 1, 2, 1, 1)):
    """Random label sequences; one video holds most of the frames."""
    rng = random.Random(seed)
    rows = []
    for v, n in enumerate([*lengths, hot]):
        for i in range(1, n + 1):
            rows.append((f"v{v}", i, rng.choices(LABELS, weights)[0], rng.randint(1, 60) / 1000.0))
    rng.shuffle(rows)
    return rows


def by_video(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def detection(label):
    return (label or "None").lower() != "none"


def positive(label):
    low = (label or "None").lower()
    return "fire" in low or "smoke" in low


def sticky(seq, window, thr):
    buf, out = [False] * window, []
    for i, r in enumerate(seq):
        if detection(r[2]):
            buf[i % window] = True
        out.append("none" if sum(buf) <= thr * window else r[2])
    return out


def sliding(seq, window, thr):
    out = []
    for i, r in enumerate(seq):
        hits = sum(detection(x[2]) for x in seq[max(0, i - window + 1) : i + 1])
        out.append("none" if hits < thr * window else r[2])
    return out


def by_detection(seq, window, thr):
    n, out = 0, []
    for r in seq:
        n += detection(r[2])
        out.append("none" if min(n, window) <= thr * window else r[2])
    return out


def tpt_video(seq, window, thr):
    buf = [False] * window
    for i, r in enumerate(seq):
        if positive(r[2]):
            buf[i % window] = True
        if sum(buf) >= thr * window:
            return "positive", r[1]
    return "negative", None


def flags(label):
    low = (label or "None").lower()
    fire = low == "fire"
    return int(fire), int(fire or "smoke" in low)


def history(seq, window):
    fire, smoke, out = [0] * window, [0] * window, []
    for r in seq:
        if (r[2] or "None").lower() == "skipped":
            out.append((0.0, 0.0))
            continue
        f, s = flags(r[2])
        fire, smoke = fire[1:] + [f], smoke[1:] + [s]
        out.append((sum(fire) / window, sum(smoke) / window))
    return out


def gate(seq, period, window):
    eager, count = True, 0
    fire, smoke, out = [0] * window, [0] * window, []
    for r in seq:
        if not eager:
            count += 1
            if count < period:
                out.append((False, False, eager))
                continue
        count = 0
        dropped = (r[2] or "None").lower() == "skipped"
        if not dropped:
            f, s = flags(r[2])
            fire, smoke = fire[1:] + [f], smoke[1:] + [s]
            eager = sum(fire) > 0 or sum(smoke) > 0
        out.append((True, not dropped, eager))
    return out


def episodes(seq, gap):
    out, last = [], None
    for r in seq:
        if not positive(r[2]):
            continue
        if last is None or r[1] - last - 1 >= gap:
            out.append([r[1], r[1], 0])
        out[-1][1] = r[1]
        out[-1][2] += 1
        last = r[1]
    return [tuple(e) for e in out]


def memory(values, thr):
    """Counter of one pixel from its gray values."""
    m, prev, out = 0, None, []
    for v in values:
        if prev is not None:
            m = max(0, min(25, m + 5) - 1) if abs(v - prev) > thr else max(0, m - 1)
        out.append(m)
        prev = v
    return out


def online(images, score, period, window, thr, active_at, blk, min_count, least, excluded, idle_ms):
    """The per-channel loop over ``(frame_idx, ms, rows of gray values)``, pixel by pixel."""
    out, seen = [], None
    for index, ms, image in images:
        if seen is None or ms - seen > idle_ms:
            eager, count, before, counters = True, 0, None, None
            history = [(0, 0)] * window
        seen = ms
        h, w = len(image), len(image[0])
        held = (index, False, False, None, None, None, None, None, 0.0, 0.0)
        if not eager:
            count += 1
            if count < period:
                out.append((*held, eager))
                continue
        count = 0
        last, before = before, image
        if last is None or (len(last), len(last[0])) != (h, w):
            counters = None
            out.append((index, True, *held[2:], eager))
            continue
        counters = counters or [[0] * w for _ in range(h)]
        for y in range(h):
            for x in range(w):
                c = counters[y][x]
                counters[y][x] = max(0, min(25, c + 5) - 1) if abs(image[y][x] - last[y][x]) > thr else max(0, c - 1)
        boxes = []
        for y in range(0, h, blk[0]):
            for x in range(0, w, blk[1]):
                part = [(i, j) for i in range(y, min(h, y + blk[0])) for j in range(x, min(w, x + blk[1]))]
                if sum(counters[i][j] >= active_at for i, j in part) >= min_count:
                    boxes.append((x, y, min(w, x + blk[1]), min(h, y + blk[0])))
        if not boxes:
            out.append((index, True, *held[2:], eager))
            continue
        x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes)
        x2, y2 = max(b[2] for b in boxes), max(b[3] for b in boxes)
        if x2 - x1 < least[0]:
            x1 = min(w - least[0], max(0, x1 - (least[0] - (x2 - x1)) // 2))
            x2 = x1 + least[0]
        if y2 - y1 < least[1]:
            y1 = min(h - least[1], max(0, y1 - (least[1] - (y2 - y1)) // 2))
            y2 = y1 + least[1]
        a, b, c, d = excluded
        pixels = [[114 if a <= x < c and b <= y < d else image[y][x] for x in range(x1, x2)] for y in range(y1, y2)]
        label = score(pixels)
        history = history[1:] + [flags(label)]
        fire, smoke = sum(f for f, _ in history), sum(s for _, s in history)
        eager = fire > 0 or smoke > 0
        out.append((index, True, True, x1, y1, x2, y2, label, fire / window, smoke / window, eager))
    return out
