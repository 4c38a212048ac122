"""A sequential model of the store in plain Python: what the relational forms must equal."""

from __future__ import annotations

import re

NEVER = 2**63 - 1


def enc(x):
    if isinstance(x, list):
        return f"*{len(x)}\r\n" + "".join(map(enc, x))
    if x is None:
        return "$-1\r\n"
    if isinstance(x, int):
        return f":{x}\r\n"
    if x[:1] in "+-":
        return x + "\r\n"
    return f"${len(x[1:].encode())}\r\n{x[1:]}\r\n"


class Model:
    def __init__(self):
        self.d = {}

    def live(self, k, now):
        e = self.d.get(k)
        return e if e and now < e[1] else None

    def run(self, argv, now):
        c, a = argv[0].upper(), argv[1:]
        long = lambda t: int(t) if re.fullmatch(r"[+-]?[0-9]+", t) and -(2**63) <= int(t) < 2**63 else None
        bad, over = "-ERR value is not an integer or out of range", "-ERR increment or decrement would overflow"
        if c == "SET":
            until, i = NEVER, 2
            while i < len(a):
                if a[i].upper() in ("EX", "PX") and i + 1 < len(a):
                    n = long(a[i + 1])
                    if n is None:
                        return bad
                    until = now + n * (1000 if a[i].upper() == "EX" else 1)
                    i += 2
                else:
                    return "-ERR syntax error"
            self.d[a[0]] = (a[1], until)
            return "+OK"
        if c == "GET":
            e = self.live(a[0], now)
            return "$" + e[0] if e else None
        if c == "MGET":
            return [("$" + e[0] if (e := self.live(k, now)) else None) for k in a]
        if c == "EXISTS":
            return sum(bool(self.live(k, now)) for k in a)
        if c == "DEL":
            n = 0
            for k in a:
                if self.live(k, now):
                    del self.d[k]
                    n += 1
            return n
        if c == "MSET":
            for k, v in zip(a[::2], a[1::2], strict=True):
                self.d[k] = (v, NEVER)
            return "+OK"
        if c in ("INCR", "DECR", "INCRBY", "DECRBY"):
            n = 1 if len(a) == 1 else long(a[1])
            if n is None:
                return bad
            n = -n if c[0] == "D" else n
            e = self.live(a[0], now)
            if not e:
                self.d[a[0]] = (str(n), NEVER)
                return n
            old = long(e[0])
            if old is None:
                return bad
            if not -(2**63) <= old + n < 2**63:
                return over
            self.d[a[0]] = (str(old + n), e[1])
            return old + n
        if c in ("EXPIRE", "PEXPIRE"):
            n = long(a[1])
            e = self.live(a[0], now)
            if not e:
                return 0
            self.d[a[0]] = (e[0], now + n * (1000 if c == "EXPIRE" else 1))
            return 1
        if c == "PERSIST":
            e = self.live(a[0], now)
            if not e or e[1] == NEVER:
                return 0
            self.d[a[0]] = (e[0], NEVER)
            return 1
        if c in ("TTL", "PTTL"):
            e = self.live(a[0], now)
            if not e:
                return -2
            return -1 if e[1] == NEVER else (e[1] - now) // (1000 if c == "TTL" else 1)
        if c == "SCAN":
            keys = sorted((k for k in self.d if a[0] <= k < a[1] and self.live(k, now)), key=str.encode)
            return [x for k in keys for x in ("$" + k, "$" + self.d[k][0])]
        if c == "DBSIZE":
            return sum(bool(self.live(k, now)) for k in self.d)
        raise ValueError(c)
