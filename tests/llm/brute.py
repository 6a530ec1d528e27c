"""Plain versions of the operators, for small inputs."""

import hashlib
import html
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """{id: (set size, least id reachable)} of distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    lists, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for ids in lists.values():
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            ra, rb = sorted((root(a), root(b)))
            top[rb] = ra
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(docs, length=50):
    """[(id, n_bytes, n_removed, n_spans, kept)] for rows (id, text)."""
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, kept))
    return out


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def repeats(words, least):
    """Positions in substrings of at least `least` words that occur twice, and the longest such length."""
    n, cover, longest = len(words), set(), 0
    for size in range(least, n):
        at = defaultdict(list)
        for k in range(n - size + 1):
            at[tuple(words[k : k + size])].append(k)
        for places in at.values():
            if len(places) > 1:
                longest = size
                for k in places:
                    cover |= set(range(k, k + size))
        if longest < size:
            break  # nothing longer occurs twice either
    return cover, longest


def quality(text, min_repeat=3, max_covered=0.5, max_repeat=60):
    """n_words to n_repeat_words, n_covered, longest_repeat, base_failed, kept."""
    base = base_counts(text)
    w = WORD.findall(text or "")
    cover, longest = repeats(w, min_repeat) if len({tuple(w[k : k + min_repeat]) for k in range(len(w) - min_repeat + 1)}) < len(w) - min_repeat + 1 else (set(), 0)
    failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
    return *base, len(cover), longest, failed, not failed and len(cover) <= max_covered * base[0] and longest <= max_repeat


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


class Plain:
    """The article of a parsed page, every quantity worked out anew from its definition wherever it is asked for."""

    def __init__(self, root):
        from loomspark.llm import main_text as M

        self.M, self.root = M, root
        self.own = {id(n): n.own for n in self.all(root)}
        self.body = next((n for n in self.all(root) if n.tag == "body"), root)
        for n in self.all(root):
            if self.wraps(n):
                self.own[id(n)] = 1.0
                break

    def kids(self, n):
        return [p for p in n.parts if not isinstance(p, str)]

    def all(self, n):
        return [n, *(x for p in reversed(self.kids(n)) for x in self.all(p))]

    def weight(self, n):
        return self.own[id(n)] * (self.weight(n.parent) if n.parent else 1.0)

    def chars(self, n, links=False):
        if links and n.tag != "a":
            return sum(self.chars(p, True) for p in self.kids(n))
        return sum(len(p.replace(" ", "").replace("\n", "")) if isinstance(p, str) else self.chars(p) for p in n.parts)

    def shown(self, n):
        if not self.weight(n) or n.tag == "a":
            return 0
        return sum(len(p.replace(" ", "").replace("\n", "")) if isinstance(p, str) else self.shown(p) for p in n.parts)

    def wraps(self, n):
        if self.weight(n) or n.parent and not self.weight(n.parent):
            return False
        below = self.all(n)
        if n.tag == "form":
            return 2 * self.chars(n) > self.chars(self.body) and any(p.tag in ("p", "article", "main") for p in below)
        if n.tag not in self.M.NAMED or n.readers or self.chars(n) - self.chars(n, True) <= 4 * self.shown(self.body):
            return False
        long = [p for p in below if p.tag == "p" and self.chars(p) - self.chars(p, True) >= 80]
        return len(long) >= 3 or bool(long) and any(p.tag in ("h1", "article", "main") and self.chars(p) for p in below)

    def density(self, n):
        c, links = self.chars(n), self.chars(n, True)
        if not c or not self.weight(n):
            return 0.0
        tags, link_tags = max(len(self.all(n)) - 1, 1), max(sum(p.tag == "a" for p in self.all(n)[1:]), 1)
        share = self.chars(self.body, True) / self.chars(self.body) if self.chars(self.body) else 0.0
        base = math.log(c / max(c - links, 1) * links + share * c + math.e)
        return self.weight(n) * c / tags * math.log(max(c / max(links, 1) * tags / link_tags, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1e-3)

    def sum(self, n):
        return sum(self.density(p) for p in self.kids(n))

    def heads(self, n):
        return self.weight(n) and any(x.tag == "h1" and self.chars(x) and self.lives(x, n) for x in self.all(n))

    def lives(self, x, top):
        return bool(self.weight(x)) and (x is top or self.lives(x.parent, top))

    def text(self):
        M, nodes = self.M, [n for n in self.all(self.root) if self.chars(n) and self.weight(n)]
        if not nodes:
            return ""
        best = max(nodes, key=lambda n: (self.sum(n), self.density(n), self.chars(n)))
        mains, articles = ([n for n in nodes if n.tag == t] for t in ("main", "article"))
        bounds = mains[0] if mains else articles[0] if len(articles) == 1 else None
        if bounds and 2 * self.shown(bounds) <= self.shown(nodes[0]):
            bounds = None
        if bounds and any(p is bounds for p in self.all(best)):
            best = bounds
        path = [best]
        while path[-1].parent and path[-1].tag != "body":
            path.append(path[-1].parent)
        least = min(map(self.density, path))
        kept = {id(n) for n in self.all(best)} if best.tag not in ("body", "html") else set()
        lines, line = [], []

        def end():
            text = " ".join(html.unescape("".join(line)).split())
            lines.extend([text] if text else [])
            line.clear()

        def beside(n, inner):
            """What is read of a node of the path."""
            parts = n.parts
            outer = path.index(n) > path.index(bounds) if bounds in path else False
            if outer:
                parts = [p for p in parts if p is inner or not isinstance(p, str) and self.heads(p)]
            loose = [p for p in parts if isinstance(p, str) or p is not inner and self.weight(p) and p.tag not in M.BLOCK]
            links = sum(self.chars(p, True) for p in loose if not isinstance(p, str))
            if links > 0.6 * sum(len("".join(p.split())) if isinstance(p, str) else self.chars(p) for p in loose):
                parts = [p for p in parts if p not in loose]
            for p in parts:
                if isinstance(p, str) or p is inner or not self.weight(p) or not self.chars(p):
                    yield p
                elif p.tag not in M.BLOCK or p.tag in M.TEXT and self.weight(p) == self.weight(n) or max(self.density(p), self.sum(p)) >= least or self.heads(p):
                    yield p

        def read(x):
            if isinstance(x, str):
                return line.append(x)
            if x.tag == "br":
                return line.append(" ")
            if not self.weight(x) and x not in path:
                return None
            menu = x.tag in M.MENUS and sum(p.tag == "a" for p in self.all(x)[1:]) > 1 and self.chars(x, True) > 0.6 * self.chars(x)
            if x is not path[-1] and menu and not ((x.article or id(x) in kept) and self.weight(x) >= self.weight(x.parent)):
                return None
            if x.tag in M.BLOCK:
                end()
            for p in beside(x, path[path.index(x) - 1]) if x in path[1:] else x.parts:
                read(p)
            if x.tag in M.BLOCK:
                end()

        read(path[-1])
        end()
        return "\n".join(lines)
