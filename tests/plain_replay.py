"""One record's facts, one by one: what replay must equal."""


class Replayed:
    """One record while its facts are replayed."""

    def __init__(self) -> None:
        self.seen, self.live, self.ts, self.gone = False, False, "", ""
        self.attached: dict[str, str] = {}
        self.detached: dict[str, str] = {}

    def take(self, verb: str, ts: str, true_ts: str | None, key: str | None, keys) -> None:
        if verb == "A":
            self._add(ts, true_ts or ts, [] if keys is None else list(keys))
        elif verb == "D" and self.seen and ts >= self.ts:
            self.live, self.gone = False, max(self.gone, ts)
        elif verb in ("K", "T") and self.live and key is not None:
            mine, other = (self.detached, self.attached) if verb == "K" else (self.attached, self.detached)
            later = ts >= other.get(key, "") if verb == "K" else ts > other.get(key, "") or key not in other
            if later:
                mine[key] = max(mine.get(key, ""), ts)
                other.pop(key, None)

    def _add(self, ts: str, true_ts: str, keys: list[str]) -> None:
        if self.seen and not self.live:
            if ts <= self.gone:
                return
            # A record that comes back takes the new keys for its own.
            self.attached, self.detached = {}, {}
        self.seen = self.live = True
        self.ts = max(self.ts, ts)
        for key in keys:
            if key not in self.detached or true_ts > self.detached[key]:
                self.detached.pop(key, None)
                self.attached[key] = max(self.attached.get(key, ""), true_ts)

    def row(self, rec: str) -> tuple:
        return rec, self.live, self.ts, sorted(self.attached) if self.live else []
