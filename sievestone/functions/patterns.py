"""Search configurations and what a pattern asks of them; all of it is known before any data is read."""

from __future__ import annotations

from dataclasses import dataclass, replace

PLAIN, BYTE_PREFIX, MASK_PREFIX, LONG_PREFIX = 1, 2, 3, 4


@dataclass(frozen=True)
class SearchConfig:
    """What a block's table indexes: windows of match_len bytes, all of them or those behind a prefix.

    extras (long prefixes only): windows at so many further offsets behind the prefix. base_log2 None: from the block size. Tables
    with more than max_pop percent of their bits set are not kept; they are folded while at most max_reduced_pop percent would be set.
    """

    match_len: int = 6
    prefixes: bytes = b""
    long_prefix: bytes = b""
    extras: int = 0
    base_log2: int | None = None
    max_pop: int = 70
    max_reduced_pop: int | None = None
    config_id: int = 0

    def __post_init__(self):
        if not 1 <= self.match_len <= 8:
            raise ValueError("match_len is from 1 to 8")
        if self.base_log2 is not None and not 8 <= self.base_log2 <= 23:
            raise ValueError("base_log2 is from 8 to 23")
        if self.prefixes and self.long_prefix:
            raise ValueError("either prefix bytes or one long prefix")
        if self.extras and not self.long_prefix:
            raise ValueError("extras need a long prefix")
        if not 0 <= self.extras <= 255 or not 1 <= self.max_pop <= 100:
            raise ValueError("extras are from 0 to 255, max_pop from 1 to 100")

    def with_match_len(self, n: int) -> SearchConfig:
        return replace(self, match_len=n)

    def with_byte_prefix(self, *prefixes: int | bytes) -> SearchConfig:
        """Any number of bytes; one of several may be in front of a window."""
        raw = b"".join(p if isinstance(p, bytes) else bytes([p]) for p in prefixes)
        return replace(self, prefixes=bytes(sorted(set(raw))), long_prefix=b"", extras=0)

    def with_mask_prefix(self, mask: bytes) -> SearchConfig:
        """mask: 32 bytes, a bit for each byte value."""
        if len(mask) != 32:
            raise ValueError("a mask has 32 bytes")
        return replace(self, prefixes=bytes(b for b in range(256) if mask[b >> 3] >> (b & 7) & 1), long_prefix=b"", extras=0)

    def with_long_prefix(self, prefix: bytes, extras: int = 0) -> SearchConfig:
        """A single byte without extras is a byte prefix."""
        if len(prefix) == 1 and not extras:
            return self.with_byte_prefix(prefix)
        return replace(self, long_prefix=prefix, prefixes=b"", extras=extras)

    def with_extras(self, n: int) -> SearchConfig:
        return replace(self, extras=n)

    def with_max_population(self, percent: int) -> SearchConfig:
        return replace(self, max_pop=percent)

    def with_max_reduced_population(self, percent: int) -> SearchConfig:
        return replace(self, max_reduced_pop=percent)

    @property
    def table_type(self) -> int:
        return LONG_PREFIX if self.long_prefix else PLAIN if not self.prefixes else BYTE_PREFIX if len(self.prefixes) <= 8 else MASK_PREFIX

    @property
    def reduced_pop(self) -> int:
        if self.max_reduced_pop is not None:
            return self.max_reduced_pop
        return 25 if self.table_type == PLAIN else 10

    @property
    def overlap(self) -> int:
        """Bytes of the following blocks that a block's table needs: a window that starts in the block ends in it."""
        return self.match_len + self.extras + max(0, len(self.long_prefix) - 1)

    def __str__(self) -> str:
        names = {PLAIN: "all positions", BYTE_PREFIX: f"behind any of {self.prefixes!r}", MASK_PREFIX: f"behind any of {len(self.prefixes)} bytes", LONG_PREFIX: f"behind {self.long_prefix!r}, {self.extras} extras"}
        size = "auto" if self.base_log2 is None else f"2^{self.base_log2}"
        return f"search table: {names[self.table_type]}, match length {self.match_len}, size {size}, population at most {self.max_pop} % ({self.reduced_pop} % folded)"

    def mask(self) -> bytes:
        out = bytearray(32)
        for b in self.prefixes:
            out[b >> 3] |= 1 << (b & 7)
        return bytes(out)

    def windows(self, pattern: bytes) -> list[tuple[int, bytes]]:
        """(position, window) of the pattern's windows that tables index wherever the pattern occurs."""
        m, n = self.match_len, len(pattern)
        if self.table_type == PLAIN:
            at = range(n - m + 1)
        elif self.table_type == LONG_PREFIX:
            pl = len(self.long_prefix)
            starts = [i + pl + e for i in range(n - pl + 1) if pattern.startswith(self.long_prefix, i) for e in range(self.extras + 1)]
            at = sorted({i for i in starts if i + m <= n})
        else:
            at = [i for i in range(1, n - m + 1) if pattern[i - 1] in self.prefixes]
        return [(i, pattern[i : i + m]) for i in at]

    def own_windows(self, pattern: bytes) -> set[bytes]:
        """Windows that the table of the very block has in which the pattern starts: those found from its first byte."""
        if self.table_type == PLAIN:
            first = range(1)
        elif self.table_type == LONG_PREFIX:
            first = range(len(self.long_prefix), len(self.long_prefix) + self.extras + 1) if pattern.startswith(self.long_prefix) else ()
        else:
            first = range(1, 2) if pattern[0] in self.prefixes else ()
        return {w for i, w in self.windows(pattern) if i in first}

    def prefix_only(self, pattern: bytes) -> bool:
        """The pattern holds the long prefix but no whole window behind it: only an empty table proves absence."""
        return self.table_type == LONG_PREFIX and self.long_prefix in pattern and not self.windows(pattern)

    def usable(self, pattern: bytes) -> bool:
        return bool(self.windows(pattern)) or self.prefix_only(pattern)


def checked(pattern: bytes | str) -> bytes:
    raw = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
    if not raw:
        raise ValueError("an empty pattern matches nowhere and everywhere")
    return raw
