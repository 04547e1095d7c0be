"""The session machine of a stream as a fold over its log.

State: two slots (current, next), each a dict of track, generation, life
(dormant, starting, ready) and watchdog epoch; the play state; counters.
``apply`` gives the new state, the actions and the events of one log row: facts
first, one stateChanged, then requests.  A refused command leaves the state as
it was and gives its error.
"""

from __future__ import annotations

import copy

REQUESTS = ("nextNeeded", "sourceRefreshNeeded")
SESSION = "stream_id long, log_seq long, play_state string, generation long, plan_version long, current string, next string, actions string, events string, error string"


class Refused(Exception):
    """A command that can't be done, with its stable code."""


def session_start(track: dict | None = None) -> dict:
    s = {"current": None, "next": None, "state": "idle", "made": 0, "version": 0, "played_ms": 0, "volume": 1.0, "gain": 0.0, "remembered": None}
    if track:
        s["current"] = _slot(s, track)
    return s


def _slot(s: dict, track: dict) -> dict:
    s["made"] += 1
    return {"track": track, "generation": s["made"], "life": "dormant", "epoch": 0}


def _key(track: dict) -> str:
    return track.get("attempt_id") or track["id"]


def _live(track: dict) -> bool:
    return track.get("kind") == "live" or str(track.get("format_hint", "")).lower() == "m3u8"


def _seekable(track: dict) -> bool:
    return not _live(track) and track.get("seekable") is not False


class Turn:
    """One row's work on a copy of the state."""

    def __init__(self, s: dict):
        self.s, self.actions, self.events = copy.deepcopy(s), [], []

    def act(self, verb: str, slot: dict, epoch: bool = False) -> None:
        self.actions.append(f"{verb}({slot['generation']}{',' + str(slot['epoch']) if epoch else ''})")

    def launch(self, role: str) -> None:
        slot = self.s[role]
        slot["life"], slot["epoch"] = "starting", slot["epoch"] + 1
        self.act("startCurrent" if role == "current" else "prepareNext", slot, True)

    def drop(self, role: str) -> None:
        if self.s[role]:
            self.act("cancelCurrent" if role == "current" else "cancelNext", self.s[role])
            self.s[role] = None

    def settle(self) -> bool:
        """Paused stays paused; anything else waits for media."""
        paused = self.s["state"] == "paused"
        if not paused:
            self.s["state"] = "buffering"
        return paused

    def install(self, role: str, track: dict) -> None:
        """A new attempt takes the slot: it starts, unless paused, when only the old one is cancelled."""
        old, self.s[role] = self.s[role], _slot(self.s, track)
        if self.s["state"] != "paused":
            self.launch(role)
        elif old:
            self.act("cancelCurrent" if role == "current" else "cancelNext", old)

    def fail(self, role: str, code: str) -> None:
        slot = self.s[role]
        expired, other = code == "SOURCE_AUTH_EXPIRED", self.s["next" if role == "current" else "current"]
        self.act("cancelCurrent" if role == "current" else "cancelNext", slot)
        refresh = expired and (other is None if role == "current" else other is not None)
        if refresh:
            self.events.append(f"sourceRefreshNeeded({role},{_key(slot['track'])})")
        self.events.append(f"attemptFailed({_key(slot['track'])},{code})")
        if role == "current":
            self.advance(not refresh)
        else:
            self.s["next"] = None
            if other is None:
                if self.s["state"] != "paused":
                    self.s["state"] = "idle"
                self.events.append("nextNeeded")

    def promote(self) -> bool:
        ready = self.s["next"] and self.s["next"]["life"] == "ready"
        if ready:
            self.s.update(current=self.s["next"], next=None, remembered=None, played_ms=0)
            self.settle()
            self.launch("current")
        return bool(ready)

    def advance(self, ask: bool) -> None:
        """The current attempt is over: a ready next takes its place, else the stream waits or asks."""
        if self.promote():
            return
        self.s.update(remembered=self.s["current"] and _key(self.s["current"]["track"]), current=None)
        if self.s["next"]:
            self.settle()
        else:
            self.s["state"] = "idle"
            if ask:
                self.events.append("nextNeeded")

    # Commands.

    def play(self, row: dict) -> None:
        s = self.s
        if s["state"] == "stopped":
            raise Refused("UNSUPPORTED")
        resumed, slot = s["state"] == "paused", s["current"] or s["next"]
        if slot is None:
            s["state"] = "idle"
            self.events.append("nextNeeded")
        elif slot is s["current"]:
            if resumed and slot["life"] == "ready":
                s["state"] = "playing"
            elif s["state"] != "playing":
                s["state"] = "buffering"
            active = slot["life"] != "dormant"
            if not active and s["state"] == "buffering":
                self.launch("current")
            if resumed and active:
                self.act("resumeCurrent", slot)
        else:
            s["state"] = "buffering"
            if resumed and slot["life"] != "dormant":
                self.act("resumeNext", slot)
        if resumed:
            for role in ("current", "next"):
                if s[role] and s[role]["life"] == "starting":
                    s[role]["epoch"] += 1
                    self.actions.append(f"armStartupDeadline({role},{s[role]['generation']},{s[role]['epoch']})")
        if s["next"] and s["next"]["life"] == "dormant":
            self.launch("next")

    def pause(self, row: dict) -> None:
        s = self.s
        if s["current"] and _live(s["current"]["track"]):
            raise Refused("UNSUPPORTED")
        if s["state"] not in ("playing", "buffering"):
            return
        active = next((r for r in ("current", "next") if s[r] and s[r]["life"] != "dormant"), None)
        if active:
            self.act("pauseCurrent" if active == "current" else "pauseNext", s[active])
        for role in ("current", "next"):
            if s[role] and s[role]["life"] == "starting":
                s[role]["epoch"] += 1
        s["state"] = "paused"

    def stop(self, row: dict) -> None:
        if self.s["state"] != "stopped":
            self.s.update(current=None, next=None, remembered=None, state="stopped")
            self.actions.append("stopSender")
            self.events.append("streamStopped")

    def seek(self, row: dict) -> None:
        slot = self.s["current"]
        if slot is None:
            raise Refused("UNSUPPORTED")
        if not _seekable(slot["track"]):
            raise Refused("NOT_SEEKABLE")
        self.install("current", slot["track"])
        self.settle()
        self.s["played_ms"] = row["seek_s"] * 1000

    def refresh(self, row: dict) -> None:
        held = _key(self.s["current"]["track"]) if self.s["current"] else self.s["remembered"]
        if held is None or held != _key(row["current"]):
            raise Refused("INVALID_SOURCE")
        self.install("current", row["current"])
        self.settle()
        self.s.update(remembered=None, played_ms=0)

    def plan(self, row: dict) -> None:
        s, now, then = self.s, row.get("current"), row.get("next")
        if row["plan_version"] <= s["version"]:
            return
        if then and _live(then):
            raise Refused("UNSUPPORTED")
        if now is None:
            self.drop("current")
            self.drop("next")
            s.update(remembered=None, played_ms=0, state="paused" if s["state"] == "paused" else "idle")
        elif s["current"] and _key(s["current"]["track"]) == _key(now):
            s["current"]["track"] = now
            self.plan_next(then)
        elif s["next"] and _key(s["next"]["track"]) == _key(now):
            # The prepared attempt keeps its generation.
            s.update(remembered=s["current"] and _key(s["current"]["track"]), current={**s["next"], "track": now}, next=None, played_ms=0)
            self.settle()
            self.launch("current")
            self.plan_next(then)
        else:
            self.install("current", now)
            old, s["next"] = s["next"], None
            if then:
                self.install("next", then)
            elif old:
                self.act("cancelNext", old)
            self.settle()
            s.update(remembered=None, played_ms=0)
        s["version"] = row["plan_version"]

    def plan_next(self, then: dict | None) -> None:
        slot = self.s["next"]
        if then is None:
            self.drop("next")
        elif slot and _key(slot["track"]) == _key(then):
            slot["track"] = then
        else:
            self.install("next", then)

    def level(self, row: dict, name: str) -> None:
        self.s[name] = row[name]
        for role in ("current", "next"):
            if self.s[role] and self.s[role]["life"] != "dormant":
                self.act(f"set{role.title()}{name.title()}", self.s[role])

    # What workers report; the current generation alone counts.

    def report(self, row: dict) -> None:
        s, kind = self.s, row["kind"]
        now = s["current"] if s["current"] and s["current"]["generation"] == row.get("generation") else None
        then = s["next"] if s["next"] and s["next"]["generation"] == row.get("generation") and s["next"]["life"] != "dormant" else None
        if kind == "classified" and now:
            now["track"] = {**now["track"], "kind": row["track_kind"], "seekable": row["seekable"]}
        elif kind == "prebufferReady" and now:
            now["life"] = "ready"
            if s["state"] != "paused":
                s["state"] = "playing"
        elif kind == "ended" and now:
            self.advance(True)
        elif kind == "failed" and now:
            self.fail("current", row["code"])
        elif kind == "quality" and now:
            self.events.append(f"networkQualityChanged({row['quality']})")
        elif kind == "nextReady" and then:
            then["life"] = "ready"
            if s["current"] is None:
                self.promote()
        elif kind == "nextFailed" and then:
            self.fail("next", row["code"])
        elif kind == "timeout" and s["state"] != "paused":
            slot = {"current": now, "next": then}[row["source_role"]]
            if slot and slot["life"] == "starting" and slot["epoch"] == row["watchdog_epoch"]:
                self.fail(row["source_role"], "SOURCE_TIMEOUT")


def apply(s: dict, row: dict) -> tuple[dict, list[str], list[str], str | None]:
    """State, actions, events and error after one row of the log."""
    turn, kind = Turn(s), row["kind"]
    if kind == "outputFailed":
        turn.s.update(current=None, next=None, remembered=None, state="stopped")
        return turn.s, [], [f"error({row['code']})", "streamStopped", "stateChanged"], None
    try:
        if kind in ("volume", "gain"):
            turn.level(row, kind)
        else:
            {c: getattr(turn, c) for c in ("play", "pause", "stop", "seek", "refresh", "plan")}.get(kind, turn.report)(row)
    except Refused as e:
        return s, [], [], str(e)
    facts = [e for e in turn.events if not e.startswith(REQUESTS)]
    return turn.s, turn.actions, [*facts, "stateChanged", *[e for e in turn.events if e.startswith(REQUESTS)]], None


def session_step(s: dict, row: dict) -> tuple[dict, list[dict]]:
    s, actions, events, error = apply(s, row)
    title = lambda slot: slot and slot["track"]["id"]
    out = {
        "log_seq": row["log_seq"], "play_state": s["state"], "generation": s["current"]["generation"] if s["current"] else s["made"], "plan_version": s["version"],
        "current": title(s["current"]), "next": title(s["next"]), "actions": ";".join(actions), "events": ";".join(events), "error": error,
    }
    return s, [out]
