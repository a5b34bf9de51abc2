"""Brute-force versions that the operators of the subpackage are held against."""

import base64
import hashlib
import re
import zlib

import numpy as np
import xxhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash_rows(rows, differ=4):
    prints = []
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        counts = [0] * 64
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            for b in range(64):
                counts[b] += h >> b & 1
        prints.append(sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)))
    return [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, classes(prints, [i for i, _ in rows], differ))]


def classes(prints, ids, differ):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    p = np.array(prints, np.uint64)
    for a in range(len(p)):
        for b in np.flatnonzero(np.bitwise_count(p ^ p[a]) <= differ):
            x, y = find(a), find(int(b))
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(ids))]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def base_row(doc_id, text):
    spans = base_spans(text)
    listing = ",".join(f"{k}:{a}:{e}" for a, _, e, k in spans)
    return (doc_id, *[sum(s[3] == k for s in spans) for k in BASE], hashlib.sha256(listing.encode()).hexdigest())


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Target by source, sharing anew until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def warc_rows(rows):
    out, first, used = [], {}, set()
    for i, _, page in rows:
        if i is not None:
            first[page or ""] = min(i, first.get(page or "", i))
    for i, url, page in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        data = (page or "").encode()
        digest, f = base64.b32encode(hashlib.sha1(data).digest()).decode(), first.get(page or "")
        if f is None or i == f and data not in used:
            out.append((i, len(data), digest, "response", None))
            if f is not None:
                used.add(data)
        else:
            out.append((i, len(data), digest, "revisit", f))
    return sorted(out, key=repr)


def damaged_rows(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if case == 1 else re.sub("[.!?]", "", x) if case == 2 else x
        out += [(c, t, "user" if case == 4 else r, x)] * {0: 0, 3: 2}.get(case, 1)
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def with_insertions(best):
    """``{state: (cost, audit, lines)}`` after any insertions."""
    for _ in range(4):
        for state, (cost, audit, lines) in list(best.items()):
            for role in ("user", "assistant"):
                to = NEXT.get((state, role[0]))
                new = cost + 3, audit + "I", lines + [role + ":"]
                if to is not None and (to not in best or new[:2] < best[to][:2]):
                    best[to] = new
    return best


def repair_rows(ids, rows):
    """The contract of conversation repair by a search forward that carries whole audits."""
    out = []
    for c in set(ids):
        mine = sorted([r[1:] for r in rows if r[0] == c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        seen, faults = set(), []
        for _, role, text in mine:
            dark = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not dark else "duplicate" if (role, text) in seen else "truncated" if dark[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in mine]
        best = with_insertions({"": (0, "", [])})
        for (_, role, text), fault in zip(mine, faults):
            after = {}
            for state, (cost, audit, lines) in best.items():
                ways = [(state, cost + 4, "D", [])]
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    ways += [(NEXT.get((state, role[:1])), cost + more, "K", [f"{role}:{text}"])] + [(NEXT.get((state, r[0])), cost + 3 + more, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
                for to, price, letter, line in ways:
                    new = price, audit + letter, lines + line
                    if to is not None and (to not in after or new[:2] < after[to][:2]):
                        after[to] = new
            best = with_insertions(after)
        cost, audit, lines = min(v for k, v in best.items() if k in ("", "a"))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
