"""Plain Python forms of the operators, written from their contracts only."""

import binascii
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def quality_counts(text):
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def fingerprint(text):
    import xxhash

    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """doc_id -> smallest reachable id, by comparing all pairs; prints: list of (doc_id, fp)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(prints)]


def secret_spans(text):
    text = text or ""
    out = []
    pattern = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for kind, m in [("assign", m) for m in re.finditer(pattern, text) if len(m[2]) >= 6]:
        out.append((m.start(), 0, kind, m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def secret_row(text):
    spans = secret_spans(text)
    kinds = Counter(s.split(":")[0] for s in spans)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest()


def targets(sizes):
    """source -> target from source -> size, by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_ = sum(sizes.values()), set(names)
    got = {s: 0.0 for s in names}
    excess = float(total)
    while excess > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            got[s] += excess * weight[s] / w
        excess = 0.0
        for s in sorted(open_, key=str):
            if got[s] > 3 * sizes[s]:
                excess += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                open_.discard(s)
    return got


def check_mix(docs, rows):
    """docs: (doc_id, source, text); rows: dicts of the result."""
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(words(t))
    want = targets({s: sizes[s] for _, s, _ in docs})
    source_of = {d: s for d, s, _ in docs}
    taken, longest = Counter(), Counter()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, len(words(t))) for d, _, t in docs)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in want:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6, (s, taken[s], want[s])


def check_packing(docs, rows, ids_of, window=2048):
    """Every id in exactly one piece, sequences without gaps; returns the padded share."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert sorted(d for d, _ in docs) == sorted(pieces)
    for d, text in docs:
        ids = [*ids_of(text or ""), 1]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == binascii.crc32(raw[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids)
    padded = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / max(1, padded + total)


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url_parts(url):
    """host, path and the rule that decides."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = lower(re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


def top_scores(rows, k=5):
    """(query id, rank, id, score) from (vec_id, vector); ids are distinct here."""
    import math

    sound = {
        i: [math.floor(256 * float(x)) for x in v] for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q in sorted(sound):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(sound[q], sound[c], strict=False)), c) for c in sound if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return out


def article_text(html):
    """Text of the article element of the test pages, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside = True
            if tag in ("p", "h1", "br", "article"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(html or "")
    reader.close()
    blocks = (" ".join(b.split()) for b in reader.blocks)
    return " ".join(b for b in blocks if b)


def unigram(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score) from (doc_id, text); ids are distinct."""
    import math

    held = lambda d: d is not None and binascii.crc32(str(d).encode()) % 10 == 0
    tokens = {d: [*words(lower(t)), None] for d, t in docs}
    counts = Counter()
    for d, own in tokens.items():
        if not held(d):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held(d), len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
        for d, own in tokens.items()
    }


def redacted(text, live=frozenset()):
    """Text with base secrets, then live tokens, masked: assignments, then keys, then digits."""
    if text is None:
        return None
    pattern = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    text = re.sub(pattern, lambda m: "[SECRET]" if len(m[2]) >= 6 else m[0], text)
    text = re.sub("AKIA[A-Z0-9]{16,}", "[SECRET]", text)
    text = re.sub("[0-9a-f]{24,}", "[SECRET]", text)
    for value in live:
        text = text.replace(value, "[SECRET]")
    return text


def mix_copies(docs):
    """Copies per row of (doc_id, source, text), in the order of md5 of the id."""
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(words(t))
    want = targets(sizes)
    key = lambda i: hashlib.md5(("" if docs[i][0] is None else str(docs[i][0])).encode()).hexdigest()
    done, copies = Counter(), [0] * len(docs)
    for i in sorted(range(len(docs)), key=lambda i: (key(i), docs[i][0] or 0, len(words(docs[i][2])))):
        _, s, t = docs[i]
        n = len(words(t))
        middle = done[s] + n / 2
        copies[i] = sum(middle + e * sizes[s] <= want[s] + 1e-9 for e in range(3 if n else 1))
        done[s] += n
    return copies
