"""Plain one-machine versions of the operators, to compare with."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def listed(found, kinds):
    return [f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda x: (x[0], kinds.index(x[1])))]


def secrets(text):
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return listed(found, ["assign", "access", "hex"])


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), "phone", m.end()))
    return listed(found, ["email", "ip", "card", "phone"])


def shingles(text, width):
    words = WORD.findall((text or "").translate(SMALL))
    if not words:
        return frozenset()
    span = min(width, len(words))
    return frozenset(tuple(words[k : k + span]) for k in range(len(words) - span + 1))


def groups(rows, width=3, percent=90):
    """{position: smallest linked position's id} of (id, text) rows; None ids last."""
    sets = [shingles(t, width) for _, t in rows]
    boss = list(range(len(rows)))

    def root(k):
        while boss[k] != k:
            k = boss[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                boss[root(a)] = root(b)
    members = defaultdict(list)
    for k in range(len(rows)):
        members[root(k)].append(k)
    out = {}
    for found in members.values():
        ids = [rows[k][0] for k in found if rows[k][0] is not None]
        for k in found:
            out[k] = min(ids, default=None)
    return sets, out


def passages(text, items, window=10):
    words = ITEM_WORD.findall((text or "").translate(SMALL))
    hit, found = set(), set()
    for item_id, item in items:
        own = ITEM_WORD.findall((item or "").translate(SMALL))
        size = min(window, len(own))
        runs = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1) if runs else ():
            if tuple(words[k : k + size]) in runs:
                hit.update(range(k, k + size))
                found.add(str(item_id))
    return len(words), len(hit), len(found), digest(sorted(found)), bool(hit)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} by resharing until no target is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: set = set()
    total = share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def token_rows(rows, tokenizer, end_id=1):
    """(id, start, n, crc) of (id, text) rows in ascending order."""
    out, at = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((key, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def archive(rows, min_payload=0):
    """{page_id: (bytes, digest, type, refers_to)} of (page_id, html) rows with distinct ids."""
    payloads = {k: (h or "").encode() for k, h in rows}
    first = {}
    for key, payload in payloads.items():
        first[payload] = max(key, first.get(payload, key))
    out = {}
    for key, payload in payloads.items():
        revisit = len(payload) >= min_payload and first[payload] != key
        name = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out[key] = (len(payload), name, "revisit" if revisit else "response", first[payload] if revisit else None)
    return out


def rule_of(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(SMALL)
    fits = []
    for verdict, rule in rules:
        name, slash, begin = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + begin):
            fits.append((len(rule), verdict, rule))
    return host, path, max(fits, default=(0, None, None))


def host_scores(pages, rules, damping=0.85, rounds=200):
    """{host: (trust, distrust)} of (url, html) pages."""
    seeds, links = defaultdict(Counter), Counter()
    for url, html in pages:
        host, _, (_, verdict, _) = rule_of(url, rules)
        seeds[host][verdict] += 1
        for other in re.findall(r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)""", html or ""):
            other = other.translate(SMALL)
            if host and other != host:
                links[host, other] += 1
    hosts = set(seeds) | {h for pair in links for h in pair}
    sent, got = Counter(), Counter()
    for (a, b), n in links.items():
        sent[a] += n
        got[b] += n
    base = {
        kind: {h: (1 - damping) * seeds[h][verdict] / max(1, sum(seeds[h].values())) for h in hosts}
        for kind, verdict in (("trust", "allow"), ("distrust", "block"))
    }
    score = {k: dict(v) for k, v in base.items()}
    for _ in range(rounds):
        new = {k: dict(v) for k, v in base.items()}
        for (a, b), n in links.items():
            new["trust"][b] += damping * score["trust"][a] * n / sent[a]
            new["distrust"][a] += damping * score["distrust"][b] * n / got[b]
        score = new
    return {h: (score["trust"][h], score["distrust"][h]) for h in hosts}
