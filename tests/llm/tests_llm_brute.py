"""Brute-force versions that several tests share."""

import base64
import hashlib
import re

import public_tokenizers
import tiktoken
import xxhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return [low.get(find(k)) for k in range(len(prints))]


def brute_base(text):
    out, n = [], [0, 0, 0]
    word = r"(?:(?i:(?a:password|passwd|secret|token|api_?key)))"
    kinds = (("assign", word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    for k, (name, p, ok) in enumerate(kinds):
        for m in re.finditer(p, text or "", re.ASCII):
            if ok(m):
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
                n[k] += 1
    return (*n, hashlib.sha256(",".join(x[2] for x in sorted(out)).encode()).hexdigest())


def reference(path=None):
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
