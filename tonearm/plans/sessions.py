"""The session machine over logs that hold every command and every worker's report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query, read

#: Reports of a past generation, and timers of a past epoch, are in the log too.
_LOG = """SELECT user_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, 't' || event_id % 5 AS cname, 'n' || event_id % 3 AS xname, CASE event_id % 2 WHEN 0 THEN 'SOURCE_AUTH_EXPIRED' ELSE 'DECODE_ERROR' END AS code,
  event_id % 4 <> 1 AS hit, event_id % 3 <> 1 AS timely, event_id % 2 = 0 AS first, event_id % 5 = 0 AS live, event_id % 7 <> 0 AS seekable,
  CASE event_type WHEN 'signup' THEN 'plan' WHEN 'view' THEN ['play', 'ready', 'nextReady', 'quality', 'refresh', 'volume'][event_id % 6 + 1] WHEN 'click' THEN ['pause', 'play', 'seek', 'gain', 'classified', 'ready'][event_id % 6 + 1]
    WHEN 'purchase' THEN ['ended', 'nextFailed', 'timeout', 'play'][event_id // 3 % 4 + 1] ELSE CASE event_id // 2 % 8 WHEN 0 THEN 'stop' WHEN 1 THEN 'outputFailed' WHEN 2 THEN 'refresh' ELSE 'failed' END END AS k FROM events"""


@query(f"""WITH RECURSIVE e AS ({_LOG}),
s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS i, NULL::VARCHAR AS c, NULL::BIGINT AS cg, NULL::VARCHAR AS cl, 0::BIGINT AS ce, false AS clive, true AS cseek, NULL::VARCHAR AS x, NULL::BIGINT AS xg, NULL::VARCHAR AS xl, 0::BIGINT AS xe,
  'idle' AS state, 0::BIGINT AS made, 0::BIGINT AS version, NULL::VARCHAR AS rem, ''::VARCHAR AS actions, ''::VARCHAR AS events, NULL::VARCHAR AS error FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT s.user_id, e.n, e.i,
  CASE WHEN ends THEN NULL WHEN fresh OR refreshed THEN cname WHEN prom THEN s.x WHEN gone THEN NULL ELSE s.c END, CASE WHEN ends THEN NULL WHEN instc THEN s.made + 1 WHEN prom THEN s.xg WHEN gone THEN NULL ELSE s.cg END,
  CASE WHEN ends THEN NULL WHEN instc THEN started WHEN prom OR la THEN 'starting' WHEN k = 'ready' AND hit AND s.c IS NOT NULL THEN 'ready' WHEN gone THEN NULL ELSE s.cl END,
  CASE WHEN instc THEN (NOT paused)::BIGINT WHEN prom THEN s.xe + 1 WHEN plays AND s.c IS NOT NULL THEN s.ce + la::BIGINT + armc::BIGINT WHEN stops AND s.cl = 'starting' THEN s.ce + 1 ELSE s.ce END,
  CASE WHEN newer OR refreshed OR prom THEN false WHEN classed THEN e.live ELSE s.clive END, CASE WHEN newer OR refreshed OR prom THEN true WHEN classed THEN e.seekable ELSE s.cseek END,
  CASE WHEN ends OR nfail THEN NULL WHEN instn THEN xname WHEN prom THEN NULL ELSE s.x END, CASE WHEN ends OR nfail THEN NULL WHEN instn THEN s.made + 1 + fresh::BIGINT WHEN prom THEN NULL ELSE s.xg END,
  CASE WHEN ends OR nfail THEN NULL WHEN instn THEN started WHEN prom THEN NULL WHEN ln THEN 'starting' WHEN k = 'nextReady' AND hit AND s.xl <> 'dormant' THEN 'ready' ELSE s.xl END,
  CASE WHEN instn THEN (NOT paused)::BIGINT WHEN ln OR armn OR stops AND s.xl = 'starting' THEN s.xe + 1 ELSE s.xe END,
  CASE WHEN ends THEN 'stopped' WHEN instc OR prom THEN waits WHEN plays THEN CASE WHEN s.c IS NULL THEN CASE WHEN s.x IS NULL THEN 'idle' ELSE 'buffering' END WHEN paused AND s.cl = 'ready' THEN 'playing' WHEN s.state <> 'playing' THEN 'buffering' ELSE s.state END
    WHEN stops THEN 'paused' WHEN k = 'ready' AND hit AND s.c IS NOT NULL AND NOT paused THEN 'playing' WHEN gone THEN CASE WHEN s.x IS NULL THEN 'idle' ELSE waits END WHEN nfail AND s.c IS NULL AND NOT paused THEN 'idle' ELSE s.state END,
  s.made + instc::BIGINT + instn::BIGINT, CASE WHEN newer THEN e.i ELSE s.version END, CASE WHEN ends OR fresh OR refreshed OR prom THEN NULL WHEN gone THEN s.c ELSE s.rem END,
  concat_ws(';', CASE WHEN k = 'stop' AND ends THEN 'stopSender' END,
    CASE WHEN instc THEN CASE WHEN NOT paused THEN 'startCurrent(' || (s.made + 1) || ',1)' WHEN s.c IS NOT NULL THEN 'cancelCurrent(' || s.cg || ')' END END,
    CASE WHEN instn THEN CASE WHEN NOT paused THEN 'prepareNext(' || (s.made + 1 + fresh::BIGINT) || ',1)' WHEN NOT fresh AND s.x IS NOT NULL THEN 'cancelNext(' || s.xg || ')' END END,
    CASE WHEN over AND k <> 'ended' THEN 'cancelCurrent(' || s.cg || ')' END, CASE WHEN nfail THEN 'cancelNext(' || s.xg || ')' END, CASE WHEN prom THEN 'startCurrent(' || s.xg || ',' || (s.xe + 1) || ')' END,
    CASE WHEN la THEN 'startCurrent(' || s.cg || ',' || (s.ce + 1) || ')' END, CASE WHEN plays AND paused THEN CASE WHEN s.cl <> 'dormant' THEN 'resumeCurrent(' || s.cg || ')' WHEN s.c IS NULL AND s.xl <> 'dormant' THEN 'resumeNext(' || s.xg || ')' END END,
    CASE WHEN armc THEN 'armStartupDeadline(current,' || s.cg || ',' || (s.ce + la::BIGINT + 1) || ')' END, CASE WHEN armn THEN 'armStartupDeadline(next,' || s.xg || ',' || (s.xe + 1) || ')' END, CASE WHEN ln THEN 'prepareNext(' || s.xg || ',' || (s.xe + 1) || ')' END,
    CASE WHEN stops THEN CASE WHEN s.cl <> 'dormant' THEN 'pauseCurrent(' || s.cg || ')' WHEN s.xl <> 'dormant' THEN 'pauseNext(' || s.xg || ')' END END,
    CASE WHEN k IN ('volume', 'gain') AND s.cl <> 'dormant' THEN 'setCurrent' || upper(k[1]) || k[2:] || '(' || s.cg || ')' END, CASE WHEN k IN ('volume', 'gain') AND s.xl <> 'dormant' THEN 'setNext' || upper(k[1]) || k[2:] || '(' || s.xg || ')' END),
  CASE WHEN refused IS NOT NULL THEN '' ELSE concat_ws(';', CASE WHEN k = 'outputFailed' THEN 'error(' || code || ')' END, CASE WHEN ends THEN 'streamStopped' END, CASE WHEN k = 'quality' AND hit AND s.c IS NOT NULL THEN 'networkQualityChanged(poor)' END,
    CASE WHEN over AND k <> 'ended' THEN 'attemptFailed(' || s.c || ',' || why || ')' WHEN nfail THEN 'attemptFailed(' || s.x || ',' || why || ')' END, 'stateChanged',
    CASE WHEN over AND k <> 'ended' AND why = 'SOURCE_AUTH_EXPIRED' AND s.x IS NULL THEN 'sourceRefreshNeeded(current,' || s.c || ')' WHEN nfail AND why = 'SOURCE_AUTH_EXPIRED' AND s.c IS NOT NULL THEN 'sourceRefreshNeeded(next,' || s.x || ')'
      WHEN (gone OR plays AND s.c IS NULL) AND s.x IS NULL OR nfail AND s.c IS NULL THEN 'nextNeeded' END) END, refused
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1,
  LATERAL (SELECT s.state = 'paused' AS paused, k = 'plan' AND e.i > s.version AS newer, CASE WHEN s.state = 'paused' THEN 'paused' ELSE 'buffering' END AS waits, CASE WHEN s.state = 'paused' THEN 'dormant' ELSE 'starting' END AS started,
    k = 'stop' AND s.state <> 'stopped' OR k = 'outputFailed' AS ends, k = 'classified' AND hit AND s.c IS NOT NULL AS classed, CASE WHEN k = 'timeout' THEN 'SOURCE_TIMEOUT' ELSE code END AS why, coalesce(k = 'refresh' AND coalesce(s.c, s.rem) = cname, false) AS refreshed,
    CASE k WHEN 'play' THEN CASE WHEN s.state = 'stopped' THEN 'UNSUPPORTED' END WHEN 'pause' THEN CASE WHEN s.c IS NOT NULL AND s.clive THEN 'UNSUPPORTED' END WHEN 'seek' THEN CASE WHEN s.c IS NULL THEN 'UNSUPPORTED' WHEN s.clive OR NOT s.cseek THEN 'NOT_SEEKABLE' END
      WHEN 'refresh' THEN CASE WHEN coalesce(s.c, s.rem) IS DISTINCT FROM cname THEN 'INVALID_SOURCE' END END AS refused,
    coalesce(s.c IS NOT NULL AND hit AND (k IN ('ended', 'failed') OR k = 'timeout' AND e.first AND timely AND s.state <> 'paused' AND s.cl = 'starting'), false) AS over,
    coalesce(s.xl <> 'dormant' AND hit AND (k = 'nextFailed' OR k = 'timeout' AND NOT e.first AND timely AND s.state <> 'paused' AND s.xl = 'starting'), false) AS nfail) a,
  LATERAL (SELECT k = 'play' AND refused IS NULL AS plays, k = 'pause' AND refused IS NULL AND s.state IN ('playing', 'buffering') AS stops, newer AND s.c IS DISTINCT FROM cname AS fresh, coalesce(over AND s.xl = 'ready' OR k = 'nextReady' AND hit AND s.xl <> 'dormant' AND s.c IS NULL, false) AS prom) b,
  LATERAL (SELECT plays AND coalesce(s.cl = 'dormant', false) AND s.state <> 'playing' AS la, plays AND coalesce(s.xl = 'dormant', false) AS ln, fresh OR refreshed OR k = 'seek' AND refused IS NULL AS instc, fresh OR newer AND s.x IS DISTINCT FROM xname AS instn, over AND NOT prom AS gone) d,
  LATERAL (SELECT plays AND paused AND (la OR coalesce(s.cl = 'starting', false)) AS armc, plays AND paused AND coalesce(s.xl = 'starting', false) AS armn) f)
SELECT user_id AS stream_id, i AS log_seq, state AS play_state, coalesce(cg, made) AS generation, version AS plan_version, c AS current, x AS next, actions, events, error FROM s WHERE n > 0""")
def session_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight commands and nine reports: stops, refreshes, levels, classification, failures of either role and of the output, quality, startup timeouts."""
    from ..streaming import folds, session

    view, click, paid = ("play", "prebufferReady", "nextReady", "quality", "refresh", "volume"), ("pause", "play", "seek", "gain", "classified", "prebufferReady"), ("ended", "nextFailed", "timeout", "play")

    def step(s, row):
        i, kind = row["log_seq"], row["event_type"]
        verb = {"signup": "plan", "view": view[i % 6], "click": click[i % 6], "purchase": paid[i // 3 % 4]}.get(kind) or {0: "stop", 1: "outputFailed", 2: "refresh"}.get(i // 2 % 8, "failed")
        role = "next" if verb in ("nextReady", "nextFailed") or (verb == "timeout" and i % 2) else "current"
        slot = s[role] or {"generation": 0, "epoch": 0}
        return session.session_step(s, {
            "log_seq": i, "kind": verb, "generation": slot["generation"] if i % 4 != 1 else 10**9, "watchdog_epoch": slot["epoch"] + (i % 3 == 1), "source_role": role, "code": ("SOURCE_AUTH_EXPIRED", "DECODE_ERROR")[i % 2],
            "plan_version": i, "current": {"id": f"t{i % 5}", "kind": "url", "seekable": True}, "next": {"id": f"n{i % 3}", "kind": "url"}, "seek_s": i % 60, "volume": i % 100 / 100, "gain": float(i % 12),
            "quality": "poor", "track_kind": "live" if i % 5 == 0 else "url", "seekable": i % 7 != 0,
        })

    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("log_seq"), "event_type")
    return folds.fold(e, "stream_id", ["log_seq"], step, session.session_start, session.SESSION)
