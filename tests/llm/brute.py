"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import struct

import regex
import xxhash


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def cut_windows(docs, units, width, same_document):
    """Removed positions of each row."""
    places = {}
    for i, t in docs:
        u = units(t)
        for a in range(len(u) - width + 1):
            places.setdefault(tuple(u[a:a + width]), []).append((order(i), a))
    out = []
    for i, t in docs:
        u, gone = units(t), set()
        for a in range(len(u) - width + 1):
            least = min(places[tuple(u[a:a + width])])
            if least < (order(i), a) if same_document else least[0] < order(i):
                gone.update(range(a, a + width))
        out.append(gone)
    return out


def runs(gone):
    return sum(p - 1 not in gone for p in gone)


def simhash(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def reachable(n, linked):
    part = list(range(n))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return [root(i) for i in range(n)]


def lines_removed(docs, edits=2, least=30):
    """Removed line numbers of each row."""
    seen = sorted((order(i), k, t) for i, text in docs for k, t in enumerate((text or "").encode().split(b"\n")) if len(t) >= least)
    first = {}
    for i, k, t in seen:
        first.setdefault(t, (i, k))
    near = {t: min(p for u, p in first.items() if u == t or abs(len(u) - len(t)) <= edits and levenshtein(u, t) <= edits) for t in first}
    return [{k for k, t in enumerate((text or "").encode().split(b"\n")) if len(t) >= least and near[t] < (order(i), k)} for i, text in docs]


def _hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def order_minhash(text, k=2, keep=2, components=64):
    low = (1 << 30) - 1
    h = [_hash(t) for t in regex.findall(r"[\p{L}\p{N}_]{1,12}|[^\p{L}\p{N}_ \t\n\x0b\f\r]{1,12}", text or "")]
    if not h:
        return "0" * 4 * components
    n = max(1, len(h) - k + 1)
    ring, count = [], {}
    for i in range(n):
        m = _hash(*h[i:i + k]) & ~low
        count[m] = count.get(m, -1) + 1
        occurrence = count[m]
        m = struct.unpack("<q", struct.pack("<q", m))[0]
        mixed = xxhash.xxh64_intdigest(struct.pack("<i", occurrence), xxhash.xxh64_intdigest(struct.pack("<q", m), 42))
        ring.append(((mixed - (1 << 64) if mixed >> 63 else mixed) & ~low) | (i + 1))
    places = {}
    for i in range(n):  # places follow the order in which a sort by (hash, place) meets them: text order
        places[i] = i + 1
    ring.sort()
    out = []
    for j in range(components):
        start = (j - components // 2) << (65 - components.bit_length())
        at = next((x for x, y in enumerate(ring) if y >= start), n)
        taken = [ring[(at + d) % n] for d in range(min(keep, n))]
        tops = [str(y & ~low) for y in sorted(taken, key=lambda y: (y & low, y & ~low))]
        out.append(f"{xxhash.xxh64_intdigest(','.join(tops).encode(), 42):016x}"[:4].upper())
    return "".join(out)
