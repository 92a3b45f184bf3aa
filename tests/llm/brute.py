"""Plain Python versions of the operators, for small tables."""

import base64
import hashlib
import re
from collections import defaultdict

import public_tokenizers
import tiktoken
import xxhash


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def fingerprint(text) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, threshold=2):
    """{fingerprint: smallest non-null id reachable} of (id, fingerprint) rows."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                up[root(a)] = root(b)
    ids = defaultdict(list)
    for i, f in rows:
        ids[root(f)].append(i)
    return {f: min((i for i in ids[root(f)] if i is not None), default=None) for f in fps}


def contamination(text, items, window=13):
    """(n_words, n_hit, found ids) of one text against [(item_id, text)]."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    w, hit, found = cut(text), set(), set()
    for item_id, t in items:
        v = cut(t)
        n = min(window, len(v))
        wanted = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), found
