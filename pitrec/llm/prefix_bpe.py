"""The prefix rule of BPE: which token can follow which, and the one last token of each prefix."""

from __future__ import annotations

FITS = 400_000  # answers about pairs of tokens held by a worker
START, DEAD = -1, -2  # no token before; a prefix that no path from the window's begin reaches


class Memo(dict):
    """Values by key, made when first asked for, in two generations: once `most` are held, those not asked for since the last turn go."""

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixRule:
    """For tokens that are bytes or strings; they are numbered, and `names` has them by number.

    rank: the merge order of each token of two units or more; a lower rank merges
    first, equal ranks from the left. A token's two parts are those of its own last
    merge. Tokens that their own merges never make can not occur and are left out.
    """

    def __init__(self, rank: dict):
        self.rank = dict(rank)
        self._parts: dict = {}
        self.fit: dict = {}
        self.rank = {t: r for t, r in rank.items() if self.parts(t)}
        self.longest = max(map(len, self.rank), default=1)
        self.names = list(self.rank)
        self.number = {t: k for k, t in enumerate(self.names)}
        held: dict = {}
        for t in self.rank:
            if len(t) > 2:
                held.setdefault(t[-3:], {2, 1}).add(len(t))
        #: by the last three units: the sizes of the tokens that may end there, longest first
        self.sizes = {end: tuple(sorted(n, reverse=True)) for end, n in held.items()}

    def merge(self, text) -> list:
        """The merge order itself: lowest rank first, then the leftmost."""
        part = [text[k : k + 1] for k in range(len(text))]
        while len(part) > 1:
            found = [(r, k) for k in range(len(part) - 1) if (r := self.rank.get(part[k] + part[k + 1])) is not None]
            if not found:
                break
            _, k = min(found)
            part[k : k + 2] = [part[k] + part[k + 1]]
        return part

    def parts(self, token):
        if (known := self._parts.get(token)) is None:
            whole, kept = self.rank.pop(token), None
            try:
                kept = self.merge(token)
            finally:
                self.rank[token] = whole
            known = self._parts[token] = (kept[0], kept[-1]) if len(kept) == 2 else None
        return known

    def fits(self, left: int, right: int) -> bool:
        """True if encoding the two tokens together gives them back.

        The merges that made them are undone, latest first; at no time may the
        pair at the border have merged before the merge just undone. On equal
        ranks the left pair merges first.
        """
        key = left << 32 | right
        if (known := self.fit.get(key)) is not None:
            return known
        rank, get, limit, equal, known = self.rank, self.rank.get, None, False, True
        left, right = self.names[left], self.names[right]
        while True:
            joined = get(left + right)
            if joined is not None and (limit is None or joined < limit or equal and joined == limit):
                known = False
                break
            of_left, of_right = (rank[x] if len(x) > 1 else -1 for x in (left, right))
            if of_left > of_right:
                limit, equal, left = of_left, False, self.parts(left)[1]
            elif of_right >= 0:
                limit, equal, right = of_right, True, self.parts(right)[0]
            else:
                break
        if len(self.fit) >= FITS:
            self.fit.clear()
        self.fit[key] = known
        return known

    def unit(self, unit) -> int:
        self.names.append(unit)
        return self.number.setdefault(unit, len(self.names) - 1)

    def scan(self, text, base: int, last: list[int], back: list[int], stop: int) -> None:
        """Goes on to the prefix text[:stop]: last[i] is the last token of text[:base + i] and back[i] where it starts.

        No token may start before `base`, and last[0] is the token that ends there. If a window
        is scanned anew from a meeting, prefixes right behind it may have had tokens across it; no
        path to come uses these, and they are marked DEAD.
        """
        number, sizes, fit, fits, few = self.number, self.sizes, self.fit, self.fits, (2, 1)
        for end in range(base + len(last), stop + 1):
            for size in sizes.get(text[end - 3 : end], few) if end > 2 else few:
                k = end - size
                if k < base:
                    continue
                token = number.get(text[k:end])
                if token is None:
                    if size > 1:
                        continue
                    token = self.unit(text[k:end])
                left = last[k - base]
                if left < 0:
                    if left == START:
                        break
                    continue
                good = fit.get(left << 32 | token)
                if good or good is None and fits(left, token):
                    break
            else:
                token, k = DEAD, base
            last.append(token)
            back.append(k)

    def meeting(self, back: list[int], base: int, end: int) -> int:
        """The last boundary that the paths of all tokens to come share: these start at one of the last `longest` positions."""
        live = set(range(max(base, end - self.longest + 1), end + 1))
        while len(live) > 1:  # follow the latest path back until all meet
            most = max(live)
            live.remove(most)
            live.add(back[most - base])
        return live.pop()
