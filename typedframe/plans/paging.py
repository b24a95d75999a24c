"""Page requests and responses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import AmbiguousSortField, OrderCountMismatch, UnknownSortField

#: Fixed values of the protocol.
DEFAULT_SIZE, MAX_SIZE, SAFE = 20, 1000, 1_000_000


def _split(text: str) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parse_order(text: str) -> str:
    order = text.strip().upper()
    if order not in ("ASC", "DESC"):
        raise ValueError(f"{text!r} is no direction: ASC or DESC")
    return order


def normalize_orders(orders: list[str], n: int) -> list[str]:
    """None given: all ascending."""
    if not orders:
        return ["ASC"] * n
    if len(orders) != n:
        raise OrderCountMismatch(f"{n} sort fields and {len(orders)} directions")
    return [parse_order(o) for o in orders]


@dataclass(frozen=True)
class PageRequest:
    page: int = 1
    size: int = DEFAULT_SIZE
    order_by: str = ""
    order: str = ""
    keyword: str = ""

    @classmethod
    def parse(cls, params: Mapping[str, str] | None) -> PageRequest:
        """From query parameters; what isn't a positive number counts as the default."""
        params = params or {}

        def number(key: str, default: int) -> int:
            try:
                n = int(params.get(key, ""))
            except ValueError:
                return default
            return n if n > 0 else default

        return cls(number("page", 1), min(number("size", DEFAULT_SIZE), MAX_SIZE), params.get("order_by") or params.get("sort", ""), params.get("order", ""), params.get("keyword", ""))

    def to_query(self) -> dict[str, str]:
        r = self.normalized()
        return {"size": str(r.size), "page": str(r.page)} | {k: v for k in ("order_by", "order", "keyword") if (v := getattr(r, k))}

    def normalized(self) -> PageRequest:
        return replace(self, page=max(self.page, 0) or 1, size=min(max(self.size, 0) or DEFAULT_SIZE, MAX_SIZE))

    def validate(self) -> None:
        if self.page <= 0:
            raise ValueError(f"pages count from 1; {self.page} was asked for")
        if not 0 < self.size <= MAX_SIZE:
            raise ValueError(f"size must lie between 1 and {MAX_SIZE}, got {self.size}")
        if _split(self.order) and not _split(self.order_by):
            raise ValueError("directions without sort fields")
        for o in _split(self.order):
            parse_order(o)

    def offset(self) -> int:
        r = self.normalized()
        return 0 if r.page > SAFE or r.size > SAFE else r.size * (r.page - 1)

    def response(self, total: int, data: list[Any]) -> PageResponse:
        r = self.normalized()
        return PageResponse(r, total, -(-total // r.size), data)

    def sort_keys(self, fields: list[tuple[str, str, Any]]) -> list[tuple[int, str]]:
        """(number of the selected column, direction) for each sort field; ``fields`` gives name, JSON name and identity of each."""
        if not self.order_by:
            return []
        wanted = _split(self.order_by)
        if not wanted:
            raise ValueError("order by fields cannot be empty")
        allowed: dict[str, tuple[int, Any]] = {}
        doubtful: set[str] = set()
        for i, (name, json, identity) in enumerate(fields):
            for key in dict.fromkeys((name, json)):
                if key and not (key == "-" and key == json):
                    if key in allowed and allowed[key][1] != identity:
                        doubtful.add(key)
                    allowed.setdefault(key, (i, identity))
        orders = normalize_orders(_split(self.order), len(wanted))
        for w in wanted:
            if w in doubtful:
                raise AmbiguousSortField(w)
            if w not in allowed:
                raise UnknownSortField(w)
        return [(allowed[w][0], o) for w, o in zip(wanted, orders)]


@dataclass(frozen=True)
class PageResponse:
    request: PageRequest
    total: int
    total_page: int
    data: list[Any] = field(default_factory=list)

    def has_next(self) -> bool:
        return self.request.page < self.total_page

    def has_prev(self) -> bool:
        return self.request.page > 1

    def is_empty(self) -> bool:
        return not self.data
