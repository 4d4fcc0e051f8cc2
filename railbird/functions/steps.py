"""State rules that depend on the last accepted reading.

Each rule is ``step(state, row) -> output rows`` over plain dicts.  Batch jobs
run a rule with ``carried_fold``, or with ``prefix_fold`` and the rule's ``maps`` where a key may be
large; streaming jobs run the same rule per key with Spark-held state, so all give the same
rows.  Times are microseconds.  ``reads`` names the columns that a batch job has to turn into Python values.
"""

from __future__ import annotations

import json
import re
from decimal import ROUND_HALF_UP, Decimal

from railbird import schemas as S
from railbird.functions.actions import SPACE
from railbird.functions.prefix import Digest, Mapper, Table

# ---------------------------------------------------------------- fixed values
DEBOUNCE_SECONDS = 5.0
STACK_JUMP = 9
POT_DROP = 0.9
NEW_HAND_POT_DROP = 0.5
POT_LABEL = "总底池"
HERO_HASH_THRESHOLD = 10
STREETS = {0: "preflop", 3: "flop", 4: "turn", 5: "river"}
SEAT_SWAP = 12
PLACEHOLDER = "TempUser_"
TIMEBANK_JUMP = 2
SHOWDOWN = {
    "board_cards": 5, "min_live": 2, "throttle_s": 1.0, "min_distance": 6, "min_brightness": 120.0,
    "min_texture": 50.0, "min_conf": 0.9, "history": 5, "repeats": 3,
}


# White space at a text's ends, as the batch rule (``actions.SPACE``) sees it.
EDGES = re.compile(rf"^{SPACE}+|{SPACE}+$")


def _popcount(a: int, b: int) -> int:
    return ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count()


def half_up(x: float, digits: int) -> float:
    """Rounds as the batch rules do."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


class Segment:
    """Marks the readings that begin a new hand (key: table).

    A hero reading holds the hash of one card or, with ``phash2``, of both; a change of either begins a hand.
    """

    state = "hero bigint, hero2 bigint, board int, pot double, peak double"
    extra = "boundary string, pot_latest double, pot_peak double"

    def __init__(self, threshold: int = HERO_HASH_THRESHOLD, label: str | None = POT_LABEL):
        self.threshold, self.label = threshold, label

    def __call__(self, st: dict, row: dict) -> list[dict]:
        kind, value = row["kind"], row["value"]
        boundary = self._hero_change(st, row)
        if kind == "community" and value is not None:
            before, now = st["board"] or 0, int(value)
            st["board"] = now
            if before > 0 and now == 0:
                boundary = "community_reset"
        elif kind == "pot" and value is not None and st["peak"] is not None:
            if self._labelled(row) and value < st["peak"] * NEW_HAND_POT_DROP:
                boundary = "pot_label"
        if boundary:
            st["board"], st["pot"], st["peak"] = 0, None, None
        if kind == "pot" and value is not None:
            if st["pot"] is None or value >= st["pot"] * POT_DROP:
                st["pot"] = value
                st["peak"] = value if st["peak"] is None else max(st["peak"], value)
        return [{**row, "boundary": boundary, "pot_latest": st["pot"], "pot_peak": st["peak"]}]

    def _labelled(self, row: dict) -> bool:
        return self.label is None or self.label in (row.get("text") or "")

    def _hero_change(self, st: dict, row: dict) -> str | None:
        if row["kind"] != "hero" or row.get("phash") is None:
            return None
        second, known = row.get("phash2"), st["hero2"]
        if st["hero"] is None:
            st["hero"], st["hero2"] = row["phash"], second
        elif (_popcount(st["hero"], row["phash"]) > self.threshold
              or (second is not None and known is not None and _popcount(known, second) > self.threshold)):
            st["hero"], st["hero2"] = row["phash"], second
            return "hero_change"
        elif known is None:
            st["hero2"] = second
        return None

    def maps(self, columns: list[str]) -> list[Mapper]:
        """First the hero's cards, which nothing else changes; then, with those known, the board and the pot."""
        def hero_step(st: dict, row: dict) -> list[dict]:
            return [{"boundary": self._hero_change(st, row)}]

        def see_hero(memory: dict, row: dict, _) -> int:
            pair = row.get("phash"), row.get("phash2")
            if row["kind"] != "hero" or pair[0] is None or pair in memory:
                return 0
            memory[pair] = True
            return 1

        def see_table(memory: dict, row: dict, outs: list[dict]) -> int:
            """The state keeps the sign of the last board and a peak of at least all pots seen, as long as nothing resets it."""
            if outs[0]["boundary"] == "hero_change":
                return 2
            value = row["value"]
            if row["kind"] == "community" and value is not None:
                now, before = int(value), memory.get("board")
                memory["board"] = now
                if before is None:
                    return 1
                return 2 if before > 0 and now == 0 else int((before > 0) != (now > 0))
            if row["kind"] == "pot" and value is not None:
                pot, top = (value, self._labelled(row)), memory.get("top")
                if pot[1] and top is not None and value < top * NEW_HAND_POT_DROP:
                    return 2
                memory["top"] = value if top is None else max(top, value)
                same, memory["pot"] = pot == memory.get("pot"), pot
                return int(not same)
            return 0

        def after_boundary(row: dict) -> dict:
            pot = row["value"] if row["kind"] == "pot" else None
            return {"board": 0, "pot": pot, "peak": pot}

        begins = lambda outs: outs[0]["boundary"] is not None
        cards = ["kind", *(c for c in ("phash", "phash2") if c in columns)]
        hero = "kind = 'hero' and phash is not null" if "phash" in columns else "false"
        return [
            Digest(hero_step, ["hero", "hero2"], cards, look=see_hero, resets=begins, after=lambda row: {"hero": row.get("phash"), "hero2": row.get("phash2")},
                   only=hero),
            Digest(self, ["board", "pot", "peak"], [*cards, "value", "text"], look=see_table, resets=begins, after=after_boundary,
                   only=f"({hero}) or kind in ('community', 'pot') and value is not null")]


class Debounce:
    """Drops a repeat within the window after the last accepted one (key: player, street, action)."""

    state = "last bigint"
    reads = ["at"]
    extra = "accepted boolean, since_s double"

    def __init__(self, seconds: float = DEBOUNCE_SECONDS):
        self.micros = int(seconds * 1_000_000)

    def __call__(self, st: dict, row: dict) -> list[dict]:
        last, now = st["last"], row["at"]
        gap = None if last is None else now - last
        ok = gap is None or gap >= self.micros
        if ok:
            st["last"] = now
        return [{**row, "accepted": ok, "since_s": None if gap is None else gap / 1e6}]

    def maps(self, columns: list[str]) -> list[Mapper]:
        """What was accepted before a split lies before its first row, so a window later everything forgets it."""
        def see(memory: dict, row: dict, _) -> int:
            return 2 if row["at"] - memory.setdefault("first", row["at"]) >= self.micros else 1

        return [Digest(self, ["last"], ["at"], look=see, resets=lambda outs: outs[0]["accepted"], after=lambda row: {"last": row["at"]})]


class StackJump:
    """Replaces a reading that is a digit off the previous one (key: hand, seat)."""

    state = "prev double"
    reads = ["value"]
    extra = "stack double, replaced boolean"

    def __init__(self, factor: float = STACK_JUMP):
        self.factor = factor

    def __call__(self, st: dict, row: dict) -> list[dict]:
        value, prev = row["value"], st["prev"]
        jump = bool(value is not None and prev is not None and value > 0 and prev > 0
                    and (value > prev * self.factor or value * self.factor < prev))
        stack = prev if jump else value
        if stack is not None:
            st["prev"] = stack
        return [{**row, "stack": stack, "replaced": jump}]

    def maps(self, columns: list[str]) -> list[Mapper]:
        """A reading between two others that lie within the factor's square takes no state that those don't."""
        def see(memory: dict, row: dict, _) -> int:
            value = row["value"]
            if value is None:
                return 0
            if value <= 0:
                return 2
            low, high = memory.get("low"), memory.get("high")
            if low is not None and low <= value <= high and high <= 0.98 * self.factor * self.factor * low:
                return 0
            memory["low"], memory["high"] = (value, value) if low is None else (min(low, value), max(high, value))
            return 1

        return [Digest(self, ["prev"], ["value"], look=see, only="value is not null", after=lambda row: {"prev": row["value"]},
                       resets=lambda outs: outs[0]["value"] is not None and not outs[0]["replaced"])]


class PotMonotone:
    """Ignores a pot that shrinks by more than a tenth (key: hand)."""

    state = "latest double"
    reads = ["value"]
    extra = "accepted boolean, pot_before double, pot double"

    def __init__(self, keep: float = POT_DROP):
        self.keep = keep

    def __call__(self, st: dict, row: dict) -> list[dict]:
        value, before = row["value"], st["latest"]
        ok = value is not None and (before is None or value >= before * self.keep)
        if ok:
            st["latest"] = value
        return [{**row, "accepted": ok, "pot_before": before, "pot": st["latest"]}]

    def maps(self, columns: list[str]) -> list[Mapper]:
        """Only a pot above all before it in its split can be the first to be accepted."""
        def see(memory: dict, row: dict, _) -> int:
            value, top = row["value"], memory.get("top")
            if value is None or top is not None and value <= top:
                return 0
            memory["top"] = value
            return 1

        return [Digest(self, ["latest"], ["value"], look=see, only="value is not null", resets=lambda outs: outs[0]["accepted"], after=lambda row: {"latest": row["value"]})]


class Timer:
    """Attributes decision time and timebank use to the seat's next event (key: hand, seat).

    ``kind`` timer carries a countdown, or no value once it has gone; an event
    also ends a running countdown, since none is shown while one acts.
    """

    state = "countdown double, started bigint, pending bigint, timebank boolean"
    reads = ["kind", "value", "at"]
    extra = "decision_time_ms bigint, used_timebank boolean"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        if row["kind"] == "timer" and row["value"] is not None:
            if st["started"] is None:
                st["started"] = row["at"]
            elif row["value"] > st["countdown"] + TIMEBANK_JUMP:
                st["timebank"] = True
            st["countdown"] = row["value"]
            return []
        if st["started"] is not None:
            st["pending"] = (row["at"] - st["started"]) // 1000
            st["started"] = st["countdown"] = None
        if row["kind"] == "timer":
            return []
        out = {**row, "decision_time_ms": st["pending"], "used_timebank": bool(st["timebank"])}
        st["pending"] = st["timebank"] = None
        return [out]


class SeatLifecycle:
    """Applies observed seat states, skipping illegal moves (key: table, seat).

    An empty seat passes through active when it is seen folded, all in or
    leaving; ``new_hand`` brings folded and all-in seats back.
    """

    state = "seat_state string"
    extra = "from_state string, effective_state string, legal boolean, promoted boolean, skippable boolean"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        start = current = st["seat_state"] or "empty"
        target, promoted, legal = row["target"], False, True
        if target == "new_hand":
            current = "active" if current in ("folded", "all_in") else current
        else:
            if current == "empty" and target not in ("empty", "sitting_out", "active"):
                current, promoted = "active", True
            if target != current:
                legal = target in S.SEAT_TRANSITIONS.get(current, [])
                current = target if legal else current
        st["seat_state"] = current
        return [{**row, "from_state": start, "effective_state": current, "legal": legal,
                 "promoted": promoted, "skippable": current in S.SKIPPABLE_STATES}]

    def maps(self, columns: list[str]) -> list[Mapper]:
        return [Table(self, "seat_state", [None, *S.SEAT_TRANSITIONS], ["target"])]


class SeatName:
    """The name a seat keeps from hand to hand (key: table, seat).

    ``readable`` is a name reading, or nothing where it can't be a name.  A real name stays until the avatar
    differs by more than ``swap`` bits; a placeholder, made from the avatar, gives way to the first real name.
    """

    state = "name string, phash bigint"
    extra = "player_name string, renamed boolean, assigned boolean"

    def __init__(self, swap: int = SEAT_SWAP):
        self.swap = swap

    def __call__(self, st: dict, row: dict) -> list[dict]:
        before, known, seen, text = st["name"], st["phash"], row["phash"], row["readable"]
        swapped = before is not None and known is not None and seen is not None and _popcount(known, seen) > self.swap
        open_ = before is None or swapped or before.startswith(PLACEHOLDER)
        new = self._new(row) if open_ and (text or before is None or swapped) else None
        if new is not None:
            st["name"], st["phash"] = new, seen
        elif known is None:
            st["phash"] = seen
        return [{**row, "player_name": st["name"], "renamed": st["name"] != before, "assigned": new is not None}]

    def _new(self, row: dict) -> str | None:
        if row["readable"]:
            return row["readable"]
        return None if row["phash"] is None else f"{PLACEHOLDER}{row['phash'] & 0xFFFFFFFFFFFFFFFF:064b}"[: len(PLACEHOLDER) + 8]

    def maps(self, columns: list[str]) -> list[Mapper]:
        """The same reading says nothing new to a name that it left as it was."""
        def see(memory: dict, row: dict, _) -> int:
            pair = row["readable"], row["phash"]
            if pair == (None, None) or pair in memory:
                return 0
            memory[pair] = True
            return 1

        return [Digest(self, ["name", "phash"], ["readable", "phash"], look=see, only="readable is not null or phash is not null", resets=lambda outs: outs[0]["assigned"],
                       after=lambda row: {"name": self._new(row), "phash": row["phash"]})]


class ShowdownGate:
    """Decides on one candidate reading of a seat's shown cards (key: table).

    The last shows of a seat outlive the hand; throttle and accepted cards do not.
    """

    state = "memory string"
    extra = "reason string, accepted boolean"

    def __init__(self, **limits: float):
        self.limits = {**SHOWDOWN, **limits}

    def __call__(self, st: dict, row: dict) -> list[dict]:
        m = json.loads(st["memory"]) if st["memory"] else {"hand": None, "at": {}, "shown": {}, "hist": {}}
        hand = str(row["hand_id"])
        if m["hand"] != hand:
            m["hand"], m["at"], m["shown"] = hand, {}, {}
        seat = str(row["seat"])
        reason = self.gate(m["at"], row, seat) or self.weigh(m, row, seat)
        st["memory"] = json.dumps(m, sort_keys=True)
        return [{**row, "reason": reason, "accepted": reason == "accepted"}]

    def gate(self, at: dict, row: dict, seat: str) -> str | None:
        """Why a reading goes no further, by itself and the time of the seat's last one that did (``at``)."""
        lim = self.limits
        if len(_cards(row["board"])) < lim["board_cards"]:
            return "gate1_board"
        if (row["live_seats"] or 0) < lim["min_live"]:
            return "gate2_live"
        if row["is_hero"]:
            return "hero_seat"
        last = at.get(seat)
        if last is not None and row["at"] - last < lim["throttle_s"] * 1e6:
            return "throttled"
        if row["hash_distance"] is None or row["hash_distance"] < lim["min_distance"]:
            return "no_overlay"
        if (row["brightness"] or 0.0) < lim["min_brightness"]:
            return "dark_cards_area"
        if (row["texture"] or 0.0) < lim["min_texture"]:
            return "uniform_back"
        at[seat] = row["at"]
        return None

    def weigh(self, m: dict, row: dict, seat: str) -> str:
        """What becomes of a reading that has passed the gates, by the shows of its hand and the last ones of its seat."""
        lim, board = self.limits, _cards(row["board"])
        if seat in m["shown"]:
            return "already_accepted"
        cards = [row[c] for c, q in (("card1", "conf1"), ("card2", "conf2"))
                 if row[c] and (row[q] is None or row[q] >= lim["min_conf"])]
        if len(cards) < 2:
            unsure = any(row[c] and row[q] is not None and row[q] < lim["min_conf"]
                         for c, q in (("card1", "conf1"), ("card2", "conf2")))
            return "gate5_low_conf" if unsure else "incomplete"
        if cards[0] == cards[1]:
            return "gate6a_same_card"
        hist = [*m["hist"].get(seat, []), cards][-lim["history"]:]
        m["hist"][seat] = hist
        if hist.count(cards) >= lim["repeats"]:
            return "gate6b_repeated"
        taken = {c for pair in m["shown"].values() for c in pair}
        if any(c in board for c in cards):
            return "gate6c_on_board"
        if any(c in taken for c in cards):
            return "gate6c_other_seat"
        m["shown"][seat] = cards
        return "accepted"


def _cards(board: str | None) -> list[str]:
    return [c for c in (board or "").split(",") if c]


class ShowdownThrottle:
    """The part of the gate that one stretch of a hand decides (key: table, stretch); what passes has no reason yet."""

    state = "at string"
    extra = "reason string"

    def __init__(self, gate: ShowdownGate):
        self.gate = gate

    def __call__(self, st: dict, row: dict) -> list[dict]:
        st["at"] = st["at"] or {}
        return [{**row, "reason": self.gate.gate(st["at"], row, str(row["seat"]))}]


class ShowdownHistory:
    """The rest of the gate, for readings that have passed so far (key: table)."""

    state = "stretch bigint, shown string, hist string"
    extra = ""

    def __init__(self, gate: ShowdownGate):
        self.gate = gate

    def __call__(self, st: dict, row: dict) -> list[dict]:
        if st["hist"] is None or st["stretch"] != row["stretch"]:
            st["stretch"], st["shown"], st["hist"] = row["stretch"], {}, st["hist"] or {}
        return [{**row, "reason": self.gate.weigh(st, row, str(row["seat"]))}]


class Changed:
    """Passes action texts that differ from the last non-empty one (key: hand, seat)."""

    state = "text string"
    extra = "cleaned string, prev_text string"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        text, prev = EDGES.sub("", row["text"] or ""), st["text"]
        if not text or text == prev:
            return []
        st["text"] = text
        return [{**row, "cleaned": text, "prev_text": prev}]


class Betting:
    """Largest chip move so far on the street (key: hand, street)."""

    state = "top double"
    extra = "current_to_call double, is_first_bet_this_street boolean"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        top, delta = st["top"], row["stack_delta"]
        if delta is not None and delta > 2:
            st["top"] = delta if top is None else max(top, delta)
        return [{**row, "current_to_call": top or 0.0, "is_first_bet_this_street": top is None}]


class Pointer:
    """Follows the decision timer from seat to seat (key: hand)."""

    state = "seat int, value int, at bigint"
    extra = ("tag string, of_seat int, last_timer_value int, reason string, next_seat int, time_since_timer double")

    def __init__(self, recent_s: float = 5.0):
        self.recent_s = recent_s

    def __call__(self, st: dict, row: dict) -> list[dict]:
        seat, last, out = row["seat"], st["seat"], []
        note = lambda tag, reason, nxt, since: out.append({
            **row, "tag": tag, "of_seat": last, "last_timer_value": st["value"], "reason": reason,
            "next_seat": nxt, "time_since_timer": since})
        if seat is not None and seat != last:
            if last is not None:
                note("pointer.action_inferred", "timer_moved_to_next", seat, None)
            note("pointer.timer_moved", None, seat, None)
        elif seat is None and last is not None and (row["at"] - st["at"]) / 1e6 < self.recent_s:
            note("pointer.action_inferred", None, None, half_up((row["at"] - st["at"]) / 1e6, 2))
        st["seat"], st["value"], st["at"] = seat, row["value"], row["at"]
        return out


class Phase:
    """Checks observed hand phases against the legal order (key: hand)."""

    state = "phase string"
    extra = "from_phase string, legal boolean"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        before, phase = st["phase"] or "between_hands", row["phase"]
        known = before in S.HAND_PHASES
        following = S.HAND_PHASES[(S.HAND_PHASES.index(before) + 1) % len(S.HAND_PHASES)] if known else None
        early = before in S.ACTING_PHASES and phase == "settling"
        st["phase"] = phase
        return [{**row, "from_phase": before, "legal": phase in (before, following) or early}]


class Board:
    """Keeps the first clean board of every street (key: hand)."""

    state = "seen string"
    extra = "street string"
    sizes = {3: "flop", 4: "turn"}

    def __call__(self, st: dict, row: dict) -> list[dict]:
        cards = [c for c in (row["board"] or "").split(",") if c]
        street = "river" if len(cards) >= 5 else self.sizes.get(len(cards))
        seen = (st["seen"] or "").split(",")
        if street is None or street in seen or len(set(cards)) != len(cards):
            return []
        st["seen"] = ",".join([*filter(None, seen), street])
        return [{**row, "street": street}]


class Numbering:
    """Numbers a hand's events after its injected posts (key: hand)."""

    state = "n int"
    extra = "sequence_number int"

    def __init__(self, posted: int = 2):
        self.posted = posted

    def __call__(self, st: dict, row: dict) -> list[dict]:
        st["n"] = (st["n"] or self.posted) + 1
        return [{**row, "sequence_number": st["n"]}]


# ---------------------------------------------------------------- the flow as a stream

class Passing:
    """A rule among rows of other kinds, which pass with nothing added."""

    def __init__(self, step, *kinds: str):
        self.step, self.kinds, self.state, self.extra = step, kinds, step.state, step.extra

    def __call__(self, st: dict, row: dict) -> list[dict]:
        return self.step(st, row) if row["kind"] in self.kinds else [row]


class HandTicks:
    """Hand, street and the pot before and after the tick of every reading (key: table)."""

    extra = "hand_no int, street string, pot_after double, pot_before double"

    def __init__(self, segment: Segment):
        self.segment = segment
        self.state = f"{segment.state}, hand_no int, street string, tick bigint, tick_at bigint, tick_pot double, before double"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        (out,) = self.segment(st, row)
        new_tick = (st["tick"], st["tick_at"]) != (row["tick"], row["at"])
        if out["boundary"] or st["hand_no"] is None:
            st["hand_no"] = (st["hand_no"] or 0) + (1 if out["boundary"] else 0)
            st["street"], st["before"] = "preflop", None
        elif new_tick:
            st["before"] = st["tick_pot"]
        st["tick"], st["tick_at"], st["tick_pot"] = row["tick"], row["at"], out["pot_latest"]
        if row["kind"] == "community" and row["value"] is not None:
            st["street"] = STREETS.get(min(int(row["value"]), 5), st["street"])
        return [{**row, "hand_no": st["hand_no"], "street": st["street"], "pot_after": out["pot_latest"], "pot_before": st["before"]}]


class SeatActions:
    """Changed, readable actions with the seat's stack before and at their tick (key: hand, seat).

    A tick's stack has to come before its action.  After a fold a seat is not read again in its hand.
    """

    state = "text string, prev double, stack double, before double, tick bigint, tick_at bigint, gone boolean"
    extra = "stack_before double, stack_after double"

    def __init__(self, out: tuple[str, ...] = ("fold",)):
        self.out, self.jump, self.changed = out, StackJump(), Changed()

    def __call__(self, st: dict, row: dict) -> list[dict]:
        if (st["tick"], st["tick_at"]) != (row["tick"], row["at"]):
            st["tick"], st["tick_at"] = row["tick"], row["at"]
            st["before"], st["stack"] = st["stack"] if st["stack"] is not None else st["before"], None
        if row["kind"] == "stack":
            (clean,) = self.jump(st, row)
            if clean["stack"] is not None:
                st["stack"] = clean["stack"] if st["stack"] is None else max(st["stack"], clean["stack"])
            return []
        if not self.changed(st, row) or row["text_action"] is None or st["gone"]:
            return []
        st["gone"] = row["text_action"] in self.out
        return [{**row, "stack_before": st["before"], "stack_after": st["stack"]}]


class Facing:
    """Numbers a hand's actions and says what each faces on its street (key: hand)."""

    state = "n int, preflop double, flop double, turn double, river double"
    extra = "sequence_number int, current_to_call double, is_first_bet_this_street boolean"

    def __call__(self, st: dict, row: dict) -> list[dict]:
        top, delta = st[row["street"]], row["moved"]
        st["n"] = (st["n"] or 0) + 1
        if delta is not None and delta > 2:
            st[row["street"]] = delta if top is None else max(top, delta)
        return [{**row, "sequence_number": st["n"], "current_to_call": top or 0.0, "is_first_bet_this_street": top is None}]


STEPS = {"changed": Changed, "betting": Betting, "pointer": Pointer, "phase": Phase, "board": Board,
         "numbering": Numbering, "segment": Segment, "debounce": Debounce, "stack_jump": StackJump, "pot_monotone": PotMonotone,
         "timer": Timer, "seat_lifecycle": SeatLifecycle, "showdown_gate": ShowdownGate}
