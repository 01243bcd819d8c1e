"""Plain Python versions of what the queries compute, from the contracts."""
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def base_signals(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    inside = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n_dup = len(lines) - len(set(lines))
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), n_dup, len(inside), failed


def repeated_bytes(docs, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in docs]
    seen = Counter(r[p:p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def contamination(texts, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(lower_ascii(text))
        if 0 < len(w) < 10:
            windows[tuple(w)].add(item)
        for i in range(len(w) - 9):
            windows[tuple(w[i:i + 10])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w = ITEM_WORD.findall(lower_ascii(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                items_here = windows.get(tuple(w[i:i + n]))
                if items_here:
                    hit.update(range(i, i + n))
                    found |= {str(x) if x is not None else "null" for x in items_here}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), sha, bool(hit)))
    return out


def unigram(docs):
    """(held_out, n_tokens, n_known, N, base_score) of (doc_id, text) rows."""
    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [WORD.findall(lower_ascii(t)) + ["\n"] for _, t in docs]
    train = Counter(w for (i, _), ws in zip(docs, tokens) if not held(i) for w in ws)
    n, v = sum(train.values()), len(train)
    return [(held(i), len(ws), sum(w in train for w in ws), n,
             sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _), ws in zip(docs, tokens)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = here
    return row[-1]


def shingles(text, k=5):
    w = ITEM_WORD.findall(lower_ascii(text))
    return [tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def near_classes(docs, least=0.8):
    """Least id of the class of each (doc_id, text): components of all pairs that align."""
    names, by = [i for i, _ in docs], {}
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sh = [shingles(t) for _, t in docs]
    for x in range(len(docs)):
        for y in range(x):
            if not sh[x] or not sh[y]:
                same = bool(docs[x][1]) and docs[x][1] == docs[y][1]
            elif sh[x] == sh[y]:
                same = True
            else:
                a, b = Counter(sh[x]), Counter(sh[y])
                n = len(sh[x]) + len(sh[y])
                common = sum((a & b).values())
                same = common / (n - common) >= least and (lambda c: c / (n - c) >= least)(lcs(sh[x], sh[y]))
            if same:
                parent[top(x)] = top(y)
    for x in range(len(docs)):
        by.setdefault(top(x), []).append(names[x])
    return [min((i for i in by[top(x)] if i is not None), default=None) for x in range(len(docs))]


def targets(sizes):
    """Target of each source by its size: weights 5, 2, 1 in code-point order, null last, ceiling 3 times."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        if not open_:
            return {s: 3.0 * sizes[s] for s in order}
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def iceberg_rows(docs, top=200):
    """docs: (text, lang, source). Rows of the source divergence audit, from its contract."""
    found = []
    docs = [(t or "", lang or "", source or "") for t, lang, source in docs]
    by_lang = defaultdict(list)
    for t, lang, source in docs:
        by_lang[lang].append((source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(t))))
    for lang, rows in by_lang.items():
        df = Counter(w for _, ws in rows for w in set(ws))
        kept = sorted(w for w, k in df.items() if k >= 3)
        count = defaultdict(Counter)
        for source, ws in rows:
            count[source].update(w for w in ws if df[w] >= 3)
        whole = sum(count.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 10 ** 9 * (c[w] + 1) // (n + len(kept)) for w in kept}
        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in p:
            items = [("pair", o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in p if o != s]
            items += [("term", w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part in ("pair", "term"):
                mine = sorted((x for x in items if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
                found += [(lang, s, part, i, v, k + 1) for k, (_, i, v) in enumerate(mine) if part == "pair" or k < top]
    return found


def simhash(text):
    import xxhash
    w = WORD.findall(lower_ascii(text))
    runs = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def hamming_components(docs, radius=4, prints=None):
    """(doc_id, hex fingerprint, component id) by comparing all pairs of fingerprints."""
    fps = prints or [simhash(t) for _, t in docs]
    nodes = sorted(set(fps))
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= radius:
            up[root(a)] = root(b)
    least = {}
    for (i, _), f in zip(docs, fps):
        r = root(f)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(docs, fps)]


def cheapest_edits(turns):
    """turns: (initial, fault); least (cost, audit) by plain recursion over the grammar's states."""
    import functools
    after = {("B", "s"): "S", ("B", "u"): "A", ("S", "u"): "A", ("E", "u"): "A", ("A", "a"): "E"}

    @functools.cache
    def best(i, state, inserted):
        options = [(0, "")] if i == len(turns) and state in "BE" else []
        for role in "ua":
            if inserted < 4 and (state, role) in after:
                c, a = best(i, after[state, role], inserted + 1)
                options.append((c + 2, "I" + a))
        if i < len(turns):
            initial, fault = turns[i]
            c, a = best(i + 1, state, 0)
            options.append((c + 3, "D" + a))
            for role in "sua" if fault in "-t" else "":
                if (state, role) in after and (role != "s" or initial == "s"):
                    c, a = best(i + 1, after[state, role], 0)
                    options.append((c + 2 * (initial != role) + (fault == "t"), ("K" if initial == role else "R") + a))
        return min(options, default=(1 << 40, ""))
    for i in range(len(turns), 0, -1):  # from the end, so that no call is deep
        for state in "BSEA":
            best(i, state, 0)
    return best(0, "B", 0)


def repaired_conversations(rows):
    """rows: (conv_id, turn, role, text); the repair contract, with ties of a turn by role and md5 as the module defines."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = cheapest_edits(tuple((r[1][:1], f) for r, f in zip(mine, faults)))
        n_out = len(audit) - audit.count("D")
        places = ["system"] * (n_out % 2) + ["user", "assistant"] * (n_out // 2)
        repaired, at, rest = [], 0, iter(mine)
        for edit in audit:
            if edit == "D":
                next(rest)
                continue
            role, text = (places[at], "") if edit == "I" else next(rest)[1:]
            repaired.append(f"{places[at] if edit == 'R' else role}:{text}")
            at += 1
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"),
                    faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return out
