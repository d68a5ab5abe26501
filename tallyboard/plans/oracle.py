"""SQL answers to the registered queries, for an engine that knows only the raw tables."""

from __future__ import annotations

from tallyboard.operators import forest
from tallyboard.operators.outcomes import SEEDS, STAGES

VIEWS = {
    "games": """
SELECT o.o_orderkey AS gameId,
       concat(CAST(year(o.o_orderdate) AS VARCHAR), CAST(year(o.o_orderdate) + 1 AS VARCHAR)) AS seasonName,
       CASE WHEN month(o.o_orderdate) >= 10 THEN 3 ELSE 2 END AS gameType,
       CAST(o.o_orderdate AS DATE) AS gameDate,
       CAST((o.o_orderkey * 37) % 1440 AS INT) AS gameTimeEST,
       CASE WHEN o.o_orderkey % 13 = 0 THEN 'Neutral Site' ELSE concat('Arena ', h.n_name) END AS venue,
       h.n_name AS homeTeamName, a.n_name AS awayTeamName,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            ELSE CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 7 AS DOUBLE) END AS homeTeamScore,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            ELSE CAST(CAST(floor(o.o_totalprice / 7) AS BIGINT) % 6 AS DOUBLE) END AS awayTeamScore,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 10 = 1 THEN 'SO'
            WHEN o.o_orderkey % 10 <= 3 THEN 'OT' ELSE 'REG' END AS lastPeriod
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation h ON c.c_nationkey = h.n_nationkey
JOIN nation a ON a.n_nationkey = (c.c_nationkey + 1 + o.o_orderkey % 24) % 25""",
    "timed": """
SELECT *, CAST(gameDate AS TIMESTAMP) + gameTimeEST * INTERVAL 1 MINUTE AS startTimeUTC,
       concat('Zone ', substr(homeTeamName, 1, 1)) AS venueTimezone
FROM games""",
    "teams": """
SELECT n.n_name AS teamName, r.r_name AS divisionName,
       CASE WHEN n.n_regionkey <= 1 THEN 'Eastern' ELSE 'Western' END AS conferenceName
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_regionkey <= 3""",
    "venues": """
SELECT concat('Arena ', n_name) AS venue,
       CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(n_nationkey * 5 - 60 AS DOUBLE) END AS venue_lat,
       CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE CAST(n_nationkey * 14 - 170 AS DOUBLE) END AS venue_long
FROM nation""",
    "snapshots": """
SELECT CAST(g.gameDate - CAST(d.lead AS INT) AS DATE) AS predDate, g.gameId, g.gameDate,
       g.homeTeamName, g.awayTeamName,
       CAST((g.gameId + d.lead) % 5 AS DOUBLE) AS homeTeamScore,
       CAST((g.gameId * 3) % 4 AS DOUBLE) AS awayTeamScore
FROM games g CROSS JOIN (SELECT 0 AS lead UNION ALL SELECT 1 AS lead) d""",
    "odds": """
SELECT gameId, homeTeamName, awayTeamName,
       CAST(CASE WHEN gameId % 2 = 0 THEN -110 - gameId % 90 ELSE 100 + gameId % 150 END AS DOUBLE) AS homeTeamOdds,
       CAST(CASE WHEN gameId % 2 = 0 THEN 100 + gameId % 120 ELSE -105 - gameId % 80 END AS DOUBLE) AS awayTeamOdds
FROM games WHERE gameId % 10 <> 0""",
    "outcomes": """
SELECT CAST(floor(event_id / 25) AS BIGINT) AS iteration, n.n_name AS teamName,
       CASE event_type WHEN 'view' THEN 'div_1' WHEN 'signup' THEN 'div_2' WHEN 'purchase' THEN 'div_3'
            WHEN 'click' THEN 'wc_1' ELSE 'missed' END AS playoffSeed,
       CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 5 END AS roundsWon
FROM events e JOIN nation n ON n.n_nationkey = e.event_id % 25""",
    # One row per side of a game, with its results.
    "sides": """
SELECT gameId, seasonName, gameType, gameDate, venue, 'home' AS side, homeTeamName AS teamName,
       awayTeamName AS opponentName, homeTeamScore AS own, awayTeamScore AS other,
       homeTeamScore, awayTeamScore, lastPeriod FROM games
UNION ALL
SELECT gameId, seasonName, gameType, gameDate, venue, 'away', awayTeamName, homeTeamName,
       awayTeamScore, homeTeamScore, homeTeamScore, awayTeamScore, lastPeriod FROM games""",
    # Position of each side's game in the team's season, and the games on earlier days.
    "timeline": """
SELECT s.*,
       CASE WHEN own > other THEN 1 ELSE 0 END AS win,
       CASE WHEN own < other AND lastPeriod = 'REG' THEN 1 ELSE 0 END AS loss,
       CASE WHEN own < other AND lastPeriod IS DISTINCT FROM 'REG' THEN 1 ELSE 0 END AS otl,
       row_number() OVER (PARTITION BY seasonName, teamName ORDER BY gameDate, gameId) AS rn,
       rank() OVER (PARTITION BY seasonName, teamName ORDER BY gameDate) - 1 AS earlier
FROM sides s""",
    # Totals per season and team of regular games, zero-filled.
    "totals": """
SELECT k.seasonName, k.teamName, k.conferenceName, k.divisionName,
       CAST(count(s.own) AS BIGINT) AS totalGames,
       CAST(coalesce(sum(CASE WHEN s.own > s.other THEN 1 ELSE 0 END), 0) AS BIGINT) AS totalWins,
       CAST(coalesce(sum(CASE WHEN s.own < s.other AND s.lastPeriod = 'REG' THEN 1 ELSE 0 END), 0) AS BIGINT) AS totalLosses,
       CAST(coalesce(sum(CASE WHEN s.own < s.other AND s.lastPeriod = 'OT' THEN 1 ELSE 0 END), 0) AS BIGINT) AS totalOTLs,
       CAST(coalesce(sum(CASE WHEN s.own > s.other THEN 2 WHEN s.lastPeriod <> 'REG' THEN 1 ELSE 0 END), 0) AS BIGINT) AS totalPoints,
       CAST(coalesce(sum(CASE WHEN s.own > s.other AND s.lastPeriod = 'REG' THEN 1 ELSE 0 END), 0) AS BIGINT) AS totalRegWins,
       CAST(coalesce(sum(CASE WHEN s.own > s.other AND s.lastPeriod <> 'SO' THEN 1 ELSE 0 END), 0) AS BIGINT) AS totalRegOTWins,
       coalesce(sum(s.own), 0.0) AS totalGoalsFor,
       coalesce(sum(s.other), 0.0) AS totalGoalsAgainst
FROM (SELECT * FROM (SELECT DISTINCT seasonName FROM games WHERE gameType = 2) q CROSS JOIN teams) k
LEFT JOIN (SELECT * FROM sides WHERE gameType = 2) s ON s.seasonName = k.seasonName AND s.teamName = k.teamName
GROUP BY ALL""",
    "ranked": """
SELECT *, row_number() OVER (PARTITION BY seasonName, divisionName ORDER BY {tiebreak}) AS divisionSeed,
       row_number() OVER (PARTITION BY seasonName, conferenceName ORDER BY {tiebreak}) AS conferenceSeed
FROM (SELECT *, totalGoalsFor - totalGoalsAgainst AS goalDifferential,
             CASE WHEN totalGames > 0 THEN totalPoints / (totalGames * 2.0) END AS pointsPercentage FROM totals)""",
    "table1": """
SELECT *, CASE WHEN divisionSeed <= 3 THEN concat('div_', divisionSeed)
               WHEN chase <= 2 THEN concat('wc_', chase) ELSE 'missed' END AS playoffSeed
FROM (SELECT *, row_number() OVER (PARTITION BY seasonName, conferenceName, divisionSeed <= 3 ORDER BY {tiebreak}) AS chase FROM ranked)""",
    # First-round pairs of every season.
    "round1": """
SELECT w.seasonName, 1 AS round, w.conferenceName,
       w.divisionName, CAST(CASE w.conferenceName WHEN 'Eastern' THEN 0 ELSE 4 END + 2 * w.place + k.k AS INT) AS slot,
       CASE k.k WHEN 0 THEN w.teamName ELSE b.teamName END AS team1,
       CASE k.k WHEN 0 THEN q.teamName ELSE c.teamName END AS team2,
       CAST(CASE k.k WHEN 0 THEN w.conferenceSeed ELSE b.conferenceSeed END AS INT) AS team1ConferenceSeed,
       CAST(CASE k.k WHEN 0 THEN q.conferenceSeed ELSE c.conferenceSeed END AS INT) AS team2ConferenceSeed,
       concat(substr(w.divisionName, 1, 1), CASE k.k WHEN 0 THEN '1' ELSE '2' END) AS team1Seed,
       CASE k.k WHEN 0 THEN concat('WC', 2 - w.place) ELSE concat(substr(w.divisionName, 1, 1), '3') END AS team2Seed
FROM (SELECT *, row_number() OVER (PARTITION BY seasonName, conferenceName ORDER BY conferenceSeed) - 1 AS place
      FROM table1 WHERE playoffSeed = 'div_1') w
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) k
JOIN table1 b ON b.seasonName = w.seasonName AND b.divisionName = w.divisionName AND b.playoffSeed = 'div_2'
JOIN table1 c ON c.seasonName = w.seasonName AND c.divisionName = w.divisionName AND c.playoffSeed = 'div_3'
JOIN table1 q ON q.seasonName = w.seasonName AND q.conferenceName = w.conferenceName
             AND q.playoffSeed = concat('wc_', 2 - w.place)""",
    # Playoff games with the winner and both sides' earlier series wins.
    "series_games": """
SELECT g.*, least(homeTeamName, awayTeamName) AS teamLow, greatest(homeTeamName, awayTeamName) AS teamHigh,
       (SELECT count(*) FROM games e WHERE e.gameType = 3 AND e.seasonName = g.seasonName AND e.gameDate < g.gameDate
          AND ((e.homeTeamName = g.homeTeamName AND e.awayTeamName = g.awayTeamName AND e.homeTeamScore > e.awayTeamScore)
            OR (e.homeTeamName = g.awayTeamName AND e.awayTeamName = g.homeTeamName AND e.awayTeamScore > e.homeTeamScore))) AS homePrior,
       (SELECT count(*) FROM games e WHERE e.gameType = 3 AND e.seasonName = g.seasonName AND e.gameDate < g.gameDate
          AND ((e.homeTeamName = g.homeTeamName AND e.awayTeamName = g.awayTeamName AND e.homeTeamScore < e.awayTeamScore)
            OR (e.homeTeamName = g.awayTeamName AND e.awayTeamName = g.homeTeamName AND e.awayTeamScore < e.homeTeamScore))) AS awayPrior
FROM games g WHERE g.gameType = 3""",
    # State of each pair after its latest played game, with 2 wins needed.
    "series": """
SELECT seasonName, teamLow, teamHigh, gameId AS lastGameId, gameDate AS lastGameDate,
       (homePrior = 1 AND homeTeamScore > awayTeamScore) OR (awayPrior = 1 AND awayTeamScore > homeTeamScore) AS decided,
       CASE WHEN homeTeamName = teamLow THEN homePrior ELSE awayPrior END
         + CASE WHEN homeTeamName = teamLow AND homeTeamScore > awayTeamScore THEN 1
                WHEN awayTeamName = teamLow AND awayTeamScore > homeTeamScore THEN 1 ELSE 0 END AS lowWins,
       CASE WHEN homeTeamName = teamHigh THEN homePrior ELSE awayPrior END
         + CASE WHEN homeTeamName = teamHigh AND homeTeamScore > awayTeamScore THEN 1
                WHEN awayTeamName = teamHigh AND awayTeamScore > homeTeamScore THEN 1 ELSE 0 END AS highWins,
       CASE WHEN homeTeamScore > awayTeamScore THEN homeTeamName ELSE awayTeamName END AS lastWinner
FROM (SELECT *, row_number() OVER (PARTITION BY seasonName, teamLow, teamHigh
                                   ORDER BY gameDate DESC, gameTimeEST DESC, gameId DESC) AS latest
      FROM series_games WHERE lastPeriod IS NOT NULL)
WHERE latest = 1""",
}

_TIEBREAK = (
    "totalPoints DESC, pointsPercentage DESC NULLS LAST, totalRegWins DESC, totalRegOTWins DESC, "
    "totalWins DESC, goalDifferential DESC, totalGoalsFor DESC, teamName"
)
_NEEDS = {
    "timed": ["games"],
    "snapshots": ["games"],
    "odds": ["games"],
    "sides": ["games"],
    "timeline": ["sides"],
    "totals": ["sides", "teams"],
    "ranked": ["totals"],
    "table1": ["ranked"],
    "round1": ["table1"],
    "series_games": ["games"],
    "series": ["series_games"],
}


def with_views(body: str, *views: str) -> str:
    """`body` preceded by the views it needs as common table expressions."""
    ordered: list[str] = []

    def need(view: str) -> None:
        for other in _NEEDS.get(view, []):
            need(other)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        need(view)
    # Materialized: each view is computed once however often it is named.
    parts = [f"{v} AS MATERIALIZED ({VIEWS[v].replace('{tiebreak}', _TIEBREAK)})" for v in ordered]
    lead = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return lead + body.strip()


def _prior(columns: str, span: int, extra: str = "") -> str:
    return f"""
SELECT {columns} FROM timeline t LEFT JOIN timeline p
  ON p.seasonName = t.seasonName AND p.teamName = t.teamName AND p.rn <= t.earlier AND p.rn > t.earlier - {span}
{extra} GROUP BY t.gameId, t.side"""


def _sum_last(measure: str, n: int) -> str:
    return f"CAST(coalesce(sum(p.{measure}) FILTER (p.rn > t.earlier - {n}), 0) AS DOUBLE)"


def _share(n: int) -> str:
    won, lost, late = (_sum_last(m, n) for m in ("win", "loss", "otl"))
    return (
        f"CASE WHEN {won} + {lost} + {late} > 0 "
        f"THEN round((2 * {won} + {late}) / (2 * ({won} + {lost} + {late})), 6) END"
    )


def _both(names: list[str], inner: str) -> str:
    """One row per game from one row per (game, side): `x` becomes homeX and awayX."""
    picks = ", ".join(
        f"max(CASE WHEN side = '{side}' THEN {expr} END) AS {name.replace('@', side)}"
        for side in ("home", "away")
        for name, expr in (n.split("=", 1) for n in names)
    )
    return f"SELECT gameId, {picks} FROM ({inner}) GROUP BY gameId"


# A missing coordinate gives null; least() alone would skip it.
_KM = (
    "CASE WHEN {a}lat + {a}long + {b}lat + {b}long IS NOT NULL THEN "
    "12742.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * "
    "cos(radians({b}lat)) * pow(sin(radians({b}long - {a}long) / 2), 2)))) END"
)


def _km(a: str, b: str) -> str:
    return _KM.format(a=a, b=b)


def build() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(name: str, body: str, *views: str) -> None:
        sql[name] = with_views(body, *views)

    # Rows and standings.
    add(
        "team_games",
        "SELECT gameId, side, seasonName, gameType, CAST(gameDate AS VARCHAR) AS gameDate, teamName, opponentName, "
        "own AS teamScore, other AS opponentScore, lastPeriod FROM sides",
        "sides",
    )
    for name, null_points in (("game_points", 0), ("game_points_reference", 1)):
        add(
            name,
            f"""SELECT gameId,
  CASE WHEN homeTeamScore > awayTeamScore THEN 2 WHEN lastPeriod IS NULL THEN {null_points}
       WHEN lastPeriod <> 'REG' THEN 1 ELSE 0 END AS homeTeamPoints,
  CASE WHEN awayTeamScore > homeTeamScore THEN 2 WHEN lastPeriod IS NULL THEN {null_points}
       WHEN lastPeriod <> 'REG' THEN 1 ELSE 0 END AS awayTeamPoints FROM games""",
            "games",
        )
    split = ", ".join(
        f"CAST(coalesce(sum({expr}) FILTER (s.side = '{side}'), 0) AS {kind}) AS total{side.title()}{label}"
        for side in ("home", "away")
        for label, expr, kind in (
            ("Games", "CASE WHEN s.own IS NOT NULL THEN 1 ELSE 0 END", "BIGINT"),
            ("Points", "CASE WHEN s.own > s.other THEN 2 WHEN s.lastPeriod <> 'REG' THEN 1 ELSE 0 END", "BIGINT"),
            ("Wins", "CASE WHEN s.own > s.other THEN 1 ELSE 0 END", "BIGINT"),
            ("Losses", "CASE WHEN s.own < s.other AND s.lastPeriod = 'REG' THEN 1 ELSE 0 END", "BIGINT"),
            ("OTLs", "CASE WHEN s.own < s.other AND s.lastPeriod = 'OT' THEN 1 ELSE 0 END", "BIGINT"),
            ("GoalsFor", "s.own", "DOUBLE"),
            ("GoalsAgainst", "s.other", "DOUBLE"),
        )
    )
    add(
        "home_away_split",
        f"""SELECT k.seasonName, k.teamName, {split}
FROM (SELECT * FROM (SELECT DISTINCT seasonName FROM games WHERE gameType = 2) q CROSS JOIN teams) k
LEFT JOIN (SELECT * FROM sides WHERE gameType = 2) s ON s.seasonName = k.seasonName AND s.teamName = k.teamName
GROUP BY k.seasonName, k.teamName""",
        "sides",
        "teams",
    )
    add(
        "standings",
        "SELECT seasonName, conferenceName, CAST(conferenceSeed AS INT) AS conferenceSeed, divisionName, "
        "CAST(divisionSeed AS INT) AS divisionSeed, playoffSeed, teamName, totalGames, totalWins, totalLosses, "
        "totalOTLs, totalPoints, round(pointsPercentage, 6) AS pointsPercentage, totalRegWins, totalRegOTWins, "
        "goalDifferential, totalGoalsFor FROM table1",
        "table1",
    )
    add(
        "seeds",
        "SELECT seasonName, teamName, CAST(divisionSeed AS INT) AS divisionSeed, "
        "CAST(conferenceSeed AS INT) AS conferenceSeed, playoffSeed FROM table1",
        "table1",
    )
    add(
        "wildcard_table",
        """SELECT seasonName, conferenceName, teamName, playoffSeed, totalPoints, CAST(seedGroup AS INT) AS seedGroup,
  CAST(CASE seedGroup WHEN 0 THEN 0 WHEN 1 THEN CAST(right(playoffSeed, 1) AS INT) ELSE 3 END AS INT) AS wildcardSeed,
  CAST(row_number() OVER (PARTITION BY seasonName, conferenceName ORDER BY seedGroup,
    CASE WHEN seedGroup = 0 THEN divisionName ELSE '' END, totalPoints DESC NULLS LAST, teamName) AS INT) AS viewRank
FROM (SELECT *, CASE WHEN playoffSeed LIKE 'div%' THEN 0 WHEN playoffSeed LIKE 'wc%' THEN 1 ELSE 2 END AS seedGroup
      FROM table1)""",
        "table1",
    )

    # History features.
    add(
        "with_venue",
        "SELECT g.gameId, g.venue, v.venue_lat, v.venue_long FROM games g LEFT JOIN venues v ON g.venue = v.venue",
        "games",
        "venues",
    )
    for name, n in (("prior_results", 3), ("prior_results_110", 110), ("prior_results_season", None)):
        span, label = (10**9, "toDate") if n is None else (n, str(n))
        add(
            name,
            _both(
                [f"@TeamPrev{w}_{label}={m}" for w, m in (("Wins", "w"), ("Losses", "l"), ("OTLs", "o"))],
                _prior(
                    "t.gameId, t.side, CAST(coalesce(sum(p.win), 0) AS BIGINT) AS w, "
                    "CAST(coalesce(sum(p.loss), 0) AS BIGINT) AS l, CAST(coalesce(sum(p.otl), 0) AS BIGINT) AS o",
                    span,
                ),
            ),
            "timeline",
        )
    shares = {110: "@TeamPointsPercentage", 3: "@TeamPrevPointsPercentage_3", 7: "@TeamPrevPointsPercentage_7"}
    add(
        "points_pct",
        _both(
            [f"{label}=s{n}" for n, label in shares.items()],
            _prior("t.gameId, t.side, " + ", ".join(f"{_share(n)} AS s{n}" for n in shares), 110),
        ),
        "timeline",
    )
    for name, scored, conceded in (
        (
            "prior_goals",
            "CASE WHEN t.side = 'home' THEN p.homeTeamScore ELSE p.awayTeamScore END",
            "CASE WHEN t.side = 'home' THEN p.awayTeamScore ELSE p.homeTeamScore END",
        ),
        ("prior_goals_team", "p.own", "p.other"),
    ):
        picks = ", ".join(
            f"coalesce(sum({expr}) FILTER (p.rn > t.earlier - {n}), 0.0) AS {key}{n}"
            for n in (3, 7)
            for key, expr in (("f", scored), ("a", conceded))
        )
        add(
            name,
            _both(
                [f"@TeamPrevGoals{w}_{n}={k}{n}" for n in (3, 7) for w, k in (("For", "f"), ("Against", "a"))],
                _prior(f"t.gameId, t.side, {picks}", 7),
            ),
            "timeline",
        )
    rest = (
        "SELECT gameId, side, CAST(date_diff('day', lag(gameDate) OVER (PARTITION BY seasonName, teamName "
        "ORDER BY gameDate, gameId), gameDate) AS INT) AS rest FROM sides"
    )
    add("rest_days", _both(["@TeamDaysSinceLastGame=rest"], rest), "sides")
    add(
        "haversine_km",
        f"""SELECT g.gameId, round({_km('a.venue_', 'b.venue_')}, 6) AS km
FROM games g LEFT JOIN venues a ON a.venue = concat('Arena ', g.homeTeamName)
LEFT JOIN venues b ON b.venue = concat('Arena ', g.awayTeamName)""",
        "games",
        "venues",
    )
    located = (
        "SELECT t.gameId, t.side, t.seasonName, t.teamName, t.rn, t.earlier, v.venue_lat AS lat, v.venue_long AS long "
        "FROM timeline t LEFT JOIN venues v ON v.venue = t.venue"
    )
    travel = f"""SELECT t.gameId, t.side, avg({_km('t.', 'p.')}) AS km FROM ({located}) t LEFT JOIN ({located}) p
  ON p.seasonName = t.seasonName AND p.teamName = t.teamName AND p.rn <= t.earlier AND p.rn > t.earlier - 7
 AND p.lat IS NOT NULL AND p.long IS NOT NULL
GROUP BY t.gameId, t.side"""
    add("travel_load", _both(["@TeamTravelDistance7Days=round(km, 6)"], travel), "timeline", "venues")
    add(
        "series_score",
        """SELECT g.gameId, CAST(s.homePrior AS BIGINT) AS homeTeamSeriesScore,
  CAST(s.awayPrior AS BIGINT) AS awayTeamSeriesScore FROM games g LEFT JOIN series_games s ON s.gameId = g.gameId""",
        "series_games",
    )
    feature_picks = ", ".join(
        [f"{_share(n)} AS s{n}" for n in shares]
        + [
            f"coalesce(sum(CASE WHEN t.side = 'home' THEN p.{a} ELSE p.{b} END) "
            f"FILTER (p.rn > t.earlier - {n}), 0.0) AS {key}{n}"
            for n in (3, 7)
            for key, a, b in (
                ("f", "homeTeamScore", "awayTeamScore"),
                ("a", "awayTeamScore", "homeTeamScore"),
            )
        ]
    )
    names = [f"{label}=s{n}" for n, label in shares.items()]
    names += [f"@TeamPrevGoals{w}_{n}={k}{n}" for n in (3, 7) for w, k in (("For", "f"), ("Against", "a"))]
    names += ["@TeamDaysSinceLastGame=rest", "@TeamTravelDistance7Days=round(km, 6)"]
    add(
        "feature_set",
        f"""SELECT f.*, CAST(s.homePrior AS BIGINT) AS homeTeamSeriesScore,
  CAST(s.awayPrior AS BIGINT) AS awayTeamSeriesScore
FROM ({_both(names, f'SELECT * FROM ({_prior("t.gameId, t.side, " + feature_picks, 110)}) JOIN ({rest}) USING (gameId, side) JOIN ({travel}) USING (gameId, side)')}) f
LEFT JOIN series_games s ON s.gameId = f.gameId""",
        "timeline",
        "venues",
        "series_games",
    )

    # Bracket and series.
    add("first_round", "SELECT * FROM round1", "round1")
    add(
        "latest_series_game",
        """SELECT seasonName, teamLow, teamHigh, CAST(gameDate AS VARCHAR) AS gameDate, gameId,
  CAST(homePrior AS BIGINT) AS homeTeamSeriesScore, CAST(awayPrior AS BIGINT) AS awayTeamSeriesScore
FROM (SELECT *, row_number() OVER (PARTITION BY seasonName, teamLow, teamHigh
              ORDER BY gameDate DESC, gameTimeEST DESC, gameId DESC) AS latest FROM series_games
      WHERE lastPeriod IS NOT NULL) WHERE latest = 1""",
        "series_games",
    )
    loser_wins = "CASE WHEN lastWinner = teamLow THEN highWins ELSE lowWins END"
    loser = "CASE WHEN lastWinner = teamLow THEN teamHigh ELSE teamLow END"
    add(
        "series_state",
        f"""SELECT seasonName, teamLow, teamHigh, lastGameId, CAST(lastGameDate AS VARCHAR) AS lastGameDate,
  CAST(lowWins AS BIGINT) AS lowWins, CAST(highWins AS BIGINT) AS highWins, decided,
  CASE WHEN decided THEN lastWinner END AS winner, CASE WHEN decided THEN {loser} END AS loser,
  CASE WHEN decided THEN CAST({loser_wins} AS BIGINT) END AS loserWins,
  CASE WHEN decided THEN '2-' || CAST({loser_wins} AS VARCHAR) END AS scoreText FROM series""",
        "series",
    )
    add(
        "series_state_best_of_7",
        f"""SELECT seasonName, teamLow, teamHigh, CAST(lowWins AS BIGINT) AS lowWins, CAST(highWins AS BIGINT) AS highWins,
  over AS decided, CASE WHEN over THEN lastWinner END AS winner,
  CASE WHEN over THEN CAST({loser_wins} AS BIGINT) END AS loserWins
FROM (SELECT s.*, (g.homePrior = 3 AND g.homeTeamScore > g.awayTeamScore)
               OR (g.awayPrior = 3 AND g.awayTeamScore > g.homeTeamScore) AS over
      FROM series s JOIN series_games g ON g.gameId = s.lastGameId)""",
        "series",
    )
    results = f"""SELECT b.*, CAST(coalesce(CASE WHEN b.team1 = s.teamLow THEN s.lowWins ELSE s.highWins END, 0) AS BIGINT) AS team1Wins,
  CAST(coalesce(CASE WHEN b.team1 = s.teamLow THEN s.highWins ELSE s.lowWins END, 0) AS BIGINT) AS team2Wins,
  coalesce(s.decided, FALSE) AS decided, CASE WHEN s.decided THEN s.lastWinner END AS winner,
  CASE WHEN s.decided THEN {loser} END AS loser,
  CASE WHEN s.decided THEN '2-' || CAST({loser_wins} AS VARCHAR) END AS scoreText
FROM round1 b LEFT JOIN series s ON s.seasonName = b.seasonName
 AND s.teamLow = least(b.team1, b.team2) AND s.teamHigh = greatest(b.team1, b.team2)"""
    add(
        "bracket_results",
        f"SELECT seasonName, round, slot, team1, team2, team1Wins, team2Wins, decided, winner, loser, scoreText FROM ({results})",
        "round1",
        "series",
    )
    carried = f"""SELECT seasonName, slot, conferenceName, divisionName, coalesce(winner, team1) AS team,
  CASE WHEN coalesce(winner, team1) = team1 THEN team1ConferenceSeed ELSE team2ConferenceSeed END AS seed FROM ({results})"""
    add(
        "next_round",
        f"""SELECT a.seasonName, 2 AS round, CAST(a.slot / 2 AS INT) AS slot, a.conferenceName, a.divisionName,
  a.team AS team1, b.team AS team2, a.seed AS team1ConferenceSeed, b.seed AS team2ConferenceSeed
FROM ({carried}) a JOIN ({carried}) b ON b.seasonName = a.seasonName AND b.slot = a.slot + 1 AND a.slot % 2 = 0""",
        "round1",
        "series",
    )
    # From round 2 on the first team advances, so the finalists won slots 0 and 4.
    finalists = f"""SELECT a.seasonName, a.team AS team1, b.team AS team2, a.seed AS seed1, b.seed AS seed2, a.conferenceName
FROM ({carried}) a JOIN ({carried}) b ON b.seasonName = a.seasonName AND a.slot = 0 AND b.slot = 4"""
    add(
        "next_round_final",
        f"""SELECT seasonName, 4 AS round, 0 AS slot, team1, team2, seed1 AS team1ConferenceSeed,
  seed2 AS team2ConferenceSeed FROM ({finalists})""",
        "round1",
        "series",
    )
    add(
        "rounds_completed",
        f"""SELECT seasonName, round, count(*) AS series, CAST(sum(CASE WHEN decided THEN 1 ELSE 0 END) AS BIGINT) AS decidedSeries,
  bool_and(decided) AS complete FROM ({results}) GROUP BY seasonName, round""",
        "round1",
        "series",
    )
    # Whole scenarios: the season's name has the scenario in front, so all views keep them apart.
    swap = "i > 0 AND gameId % 4 = i"
    logs = f"""SELECT * REPLACE (concat(i, ':', seasonName) AS seasonName, CASE WHEN {swap} THEN awayTeamScore ELSE homeTeamScore END AS homeTeamScore,
  CASE WHEN {swap} THEN homeTeamScore ELSE awayTeamScore END AS awayTeamScore)
FROM ({VIEWS["games"]}) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)"""
    chain = f", r1 AS MATERIALIZED ({results})"
    for n in (2, 3, 4):
        chain += f""", b{n} AS MATERIALIZED (SELECT a.seasonName, {n} AS round, CAST(a.slot / 2 AS INT) AS slot, a.winner AS team1, b.winner AS team2
  FROM r{n - 1} a JOIN r{n - 1} b ON b.seasonName = a.seasonName AND b.slot = a.slot + 1 AND a.slot % 2 = 0),
r{n} AS MATERIALIZED ({results.replace("FROM round1 b", f"FROM b{n} b")})"""
    rows = "seasonName, round, slot, team1, team2, team1Wins, team2Wins, decided, winner"
    chain += ", every AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {rows} FROM r{n}" for n in (1, 2, 3, 4)) + ")"
    run = "CAST(split_part(seasonName, ':', 1) AS INT) AS iteration, split_part(seasonName, ':', 2) AS seasonName"
    reached = f"""SELECT {run.replace("seasonName,", "t.seasonName,").replace("(seasonName", "(t.seasonName")}, teamName, playoffSeed, coalesce(k, 0) AS k FROM table1 t
LEFT JOIN (SELECT seasonName, winner, count(*) AS k FROM every WHERE winner IS NOT NULL GROUP BY ALL) w ON w.seasonName = t.seasonName AND w.winner = t.teamName"""
    tallies = [*[f"count(*) FILTER (playoffSeed = '{x}') AS {x}" for x in SEEDS], *[f"count(*) FILTER (k >= {k}) AS {x}" for k, x in STAGES.items()]]
    shares = [f"round(count(*) FILTER (k >= {k}) / 4.0 * 100, 6) AS {x}_share" for k, x in STAGES.items()]
    shares.append("round(count(*) FILTER (playoffSeed <> 'missed') / 4.0 * 100, 6) AS playoff_share")
    for name, body in (
        ("scenario_probabilities", f"SELECT seasonName, teamName, {', '.join([*tallies, *shares])} FROM ({reached}) GROUP BY seasonName, teamName"),
        ("scenario_brackets", f"SELECT {run}, {rows.split(', ', 1)[1]} FROM every"),
    ):
        views = with_views("", "table1", "round1", "series").rstrip()
        sql[name] = views.replace(VIEWS["games"], logs) + chain + "\n" + body
    pairs = """SELECT gameId % 20 AS iteration, seasonName, homeTeamName, awayTeamName,
  min(CAST(gameDate AS VARCHAR) || lpad(CAST(gameTimeEST AS VARCHAR), 5, '0') || lpad(CAST(gameId AS VARCHAR), 20, '0')) AS seen
FROM games WHERE gameType = 3 GROUP BY ALL"""
    rounds = f"""SELECT iteration, seasonName, count(*) AS pairs,
  CASE WHEN count(*) >= 30 THEN 4 WHEN count(*) >= 28 THEN 3 WHEN count(*) >= 24 THEN 2 WHEN count(*) >= 16 THEN 1 ELSE 0 END AS roundsScheduled,
  CASE WHEN count(*) >= 30 THEN 30 WHEN count(*) >= 28 THEN 28 WHEN count(*) >= 24 THEN 24 WHEN count(*) >= 16 THEN 16 ELSE 0 END AS covered
FROM ({pairs}) GROUP BY iteration, seasonName"""
    add(
        "rounds_scheduled",
        f"SELECT iteration, seasonName, pairs, roundsScheduled, pairs <> covered AS partialRound FROM ({rounds})",
        "games",
    )
    add(
        "partial_round_games",
        f"""SELECT g.gameId % 20 AS iteration, g.gameId, g.seasonName FROM games g
JOIN (SELECT *, row_number() OVER (PARTITION BY iteration, seasonName ORDER BY seen DESC) AS back FROM ({pairs})) p
  ON p.iteration = g.gameId % 20 AND p.seasonName = g.seasonName
 AND p.homeTeamName = g.homeTeamName AND p.awayTeamName = g.awayTeamName
JOIN ({rounds}) r ON r.iteration = p.iteration AND r.seasonName = p.seasonName AND p.back <= r.pairs - r.covered
WHERE g.gameType = 3""",
        "games",
    )
    coarse = "CAST(floor(gameTimeEST / 240) * 240 AS INT)"
    starts = f"""SELECT seasonName, venue, usualStart FROM (
  SELECT *, row_number() OVER (PARTITION BY seasonName, venue ORDER BY n DESC, usualStart) AS place FROM (
    SELECT seasonName, venue, {coarse} AS usualStart, count(*) AS n FROM timed GROUP BY ALL) WHERE n > 5) WHERE place = 1"""
    homes = """SELECT seasonName, teamName, venue, venueTimezone FROM (
  SELECT *, row_number() OVER (PARTITION BY seasonName, teamName ORDER BY n DESC, venue, venueTimezone) AS place FROM (
    SELECT seasonName, homeTeamName AS teamName, venue, venueTimezone, count(*) AS n FROM timed GROUP BY ALL)
  WHERE n > 20) WHERE place = 1"""
    add("usual_start", starts, "timed")
    add("home_venue", homes, "timed")

    def calendar(pair_rows: str, offsets: tuple[int, ...], begun: str) -> str:
        steps = ", ".join(f"({i}, {d}, {h})" for i, (d, h) in enumerate(zip(offsets, (1, 1, 2, 2, 1, 2, 1))))
        return f"""SELECT x.seasonName, x.round, x.slot, CAST(x.pos + 1 AS INT) AS gameNumber, CAST(x.day AS VARCHAR) AS gameDate,
  x.home AS homeTeamName, x.away AS awayTeamName, h.venue, h.venueTimezone, u.usualStart AS gameTimeEST, 3 AS gameType
FROM (SELECT p.seasonName, p.round, p.slot, o.pos,
        CAST(coalesce(b.first, l.last + 2 + p.late) + o.days AS DATE) AS day,
        CASE o.host WHEN 1 THEN p.team1 ELSE p.team2 END AS home, CASE o.host WHEN 1 THEN p.team2 ELSE p.team1 END AS away
      FROM ({pair_rows}) p JOIN (SELECT seasonName, max(gameDate) AS last FROM games GROUP BY seasonName) l
        ON l.seasonName = p.seasonName
      LEFT JOIN ({begun}) b ON b.seasonName = p.seasonName AND b.team1 = p.team1
      CROSS JOIN (SELECT * FROM (VALUES {steps}) q(pos, days, host)) o
      WHERE o.pos >= coalesce(b.done, 0)) x
LEFT JOIN ({homes}) h ON h.seasonName = x.seasonName AND h.teamName = x.home
LEFT JOIN ({starts}) u ON u.seasonName = x.seasonName AND u.venue = h.venue"""

    none_begun = "SELECT '' AS seasonName, '' AS team1, CAST(NULL AS DATE) AS first, 0 AS done WHERE FALSE"
    opening = """SELECT seasonName, homeTeamName AS team1, min(gameDate) AS first, count(*) AS done FROM games
  WHERE month(gameDate) = 10 AND day(gameDate) <= 5 GROUP BY ALL"""
    opened = "SELECT *, CASE WHEN conferenceName = 'Western' THEN 1 ELSE 0 END AS late FROM round1"
    regular_offsets = (0, 2, 5, 7, 10, 12, 15)
    add("series_schedule", calendar(opened, regular_offsets, none_begun), "timed", "round1")
    add("series_schedule_begun", calendar(opened, regular_offsets, opening), "timed", "round1")
    add(
        "series_schedule_final",
        calendar(
            f"SELECT seasonName, 4 AS round, 0 AS slot, team1, team2, 0 AS late FROM ({finalists})",
            (0, 3, 6, 9, 12, 15, 18),
            none_begun,
        ),
        "timed",
        "round1",
        "series",
    )
    add(
        "prune_decided",
        """SELECT gameId, seasonName FROM games g WHERE NOT EXISTS (SELECT 1 FROM series s WHERE s.decided
  AND s.seasonName = g.seasonName AND s.teamLow = least(g.homeTeamName, g.awayTeamName)
  AND s.teamHigh = greatest(g.homeTeamName, g.awayTeamName) AND g.gameDate > s.lastGameDate)""",
        "series",
    )

    # Stored forecasts.
    add(
        "read_snapshots",
        """SELECT CAST(predDate AS VARCHAR) AS predDate, kind, gameId FROM (
  SELECT *, max(kind) OVER (PARTITION BY predDate) AS wanted FROM (
    SELECT *, CASE WHEN dayofyear(predDate) % 5 = 0 OR gameId % 3 = 0 THEN 'playoff' ELSE 'regularseason' END AS kind
    FROM snapshots WHERE predDate >= DATE '1996-01-01' AND predDate < DATE '2000-01-01')) WHERE kind = wanted""",
        "snapshots",
    )

    def hit(home: str, away: str, home_p: str, away_p: str) -> str:
        return (
            f"CASE WHEN ({home} > {away} AND {home_p} > {away_p}) OR ({home} < {away} AND {home_p} < {away_p}) "
            f"OR ({home} = {away} AND {home_p} = {away_p}) THEN 1 ELSE 0 END"
        )

    add(
        "correct_outcome",
        f"SELECT gameId, {hit('homeTeamScore', 'awayTeamScore', '(gameId % 5)', '((gameId * 3) % 4)')} AS correctOutcome FROM games",
        "games",
    )
    compared = f"""SELECT p.gameId, p.gameDate, p.homeTeamName, p.awayTeamName,
  p.homeTeamScore AS homeTeamScore_predicted, p.awayTeamScore AS awayTeamScore_predicted,
  a.homeTeamScore AS homeTeamScore_actual, a.awayTeamScore AS awayTeamScore_actual, a.lastPeriod AS lastPeriod_actual,
  {hit('a.homeTeamScore', 'a.awayTeamScore', 'p.homeTeamScore', 'p.awayTeamScore')} AS correctOutcome, p.predDate
FROM snapshots p JOIN games a ON a.gameId = p.gameId"""
    shown = f"SELECT * EXCLUDE (predDate, gameDate), CAST(gameDate AS VARCHAR) AS gameDate FROM ({compared})"
    own_day = f"({compared} WHERE p.gameDate = p.predDate)"
    add("snapshot_accuracy", f"{shown} WHERE gameDate = predDate", "snapshots")
    add(
        "compare_results",
        f"""{shown} WHERE homeTeamScore_actual IS NOT NULL AND awayTeamScore_actual IS NOT NULL
 AND gameDate >= DATE '1996-01-01' AND gameDate < DATE '2001-01-01'""",
        "snapshots",
    )
    daily = "round(avg(correctOutcome), 6) AS accuracy, CAST(sum(correctOutcome) AS BIGINT) AS correct, count(*) AS games"
    finished = f"({compared} WHERE a.homeTeamScore IS NOT NULL AND a.awayTeamScore IS NOT NULL)"
    add(
        "daily_accuracy",
        f"""SELECT CAST(gameDate AS VARCHAR) AS gameDate, {daily} FROM {finished} GROUP BY gameDate
UNION ALL SELECT NULL, {daily} FROM {finished}""",
        "snapshots",
    )
    priced = f"""SELECT c.*, o.homeTeamOdds, o.awayTeamOdds FROM {own_day} c LEFT JOIN odds o
  ON o.gameId = c.gameId AND o.homeTeamName = c.homeTeamName AND o.awayTeamName = c.awayTeamName"""
    add("with_odds", f"SELECT gameId, correctOutcome, homeTeamOdds, awayTeamOdds FROM ({priced})", "snapshots", "odds")
    add(
        "missing_odds",
        f"SELECT count(*) FILTER (homeTeamOdds IS NULL) + count(*) FILTER (awayTeamOdds IS NULL) AS missingOdds FROM ({priced})",
        "snapshots",
        "odds",
    )
    returns = f"""SELECT *, CASE WHEN winnerOdds > 0 THEN winnerOdds / 100 WHEN winnerOdds < 0 THEN 100 / abs(winnerOdds)
  ELSE -1.0 END AS winnings FROM (SELECT *, CASE WHEN correctOutcome = 1 AND homeTeamScore_predicted > awayTeamScore_predicted THEN homeTeamOdds
  WHEN correctOutcome = 1 AND homeTeamScore_predicted < awayTeamScore_predicted THEN awayTeamOdds ELSE 0.0 END AS winnerOdds FROM ({priced}))"""
    add("unit_return", f"SELECT gameId, winnerOdds, round(winnings, 6) AS winnings FROM ({returns})", "snapshots", "odds")
    add(
        "unit_return_skip",
        f"SELECT gameId, CASE WHEN winnerOdds IS NOT NULL THEN round(winnings, 6) END AS winnings FROM ({returns})",
        "snapshots",
        "odds",
    )
    add(
        "daily_returns",
        f"""SELECT CAST(gameDate AS VARCHAR) AS gameDate, games, correct, round(winnings, 6) AS winnings, dayClass,
  round(sum(winnings) OVER (ORDER BY gameDate), 6) AS runningReturn
FROM (SELECT gameDate, count(*) AS games, CAST(sum(correctOutcome) AS BIGINT) AS correct, sum(winnings) AS winnings,
  CASE WHEN min(correctOutcome) = 1 THEN 'all_right' WHEN max(correctOutcome) = 0 THEN 'all_wrong' ELSE 'mixed' END AS dayClass
  FROM ({returns}) GROUP BY gameDate)""",
        "snapshots",
        "odds",
    )
    sse = "sum(pow({a} - {p}, 2))".format
    sst = "sum(pow({a} - {m}, 2))".format
    add(
        "regression_metrics",
        f"""SELECT CAST(y AS INT) AS seasonOf, count(*) AS games,
  round(({sse(a='ha', p='hp')} + {sse(a='aa', p='ap')}) / count(*) / 2, 6) AS mse,
  round((1 - {sse(a='ha', p='hp')} / {sst(a='ha', m='hm')} + 1 - {sse(a='aa', p='ap')} / {sst(a='aa', m='am')}) / 2, 6) AS r2,
  round(avg(correctOutcome), 6) AS accuracy
FROM (SELECT year(gameDate) AS y, homeTeamScore_actual AS ha, homeTeamScore_predicted AS hp, awayTeamScore_actual AS aa,
        awayTeamScore_predicted AS ap, correctOutcome,
        avg(homeTeamScore_actual) OVER (PARTITION BY year(gameDate)) AS hm,
        avg(awayTeamScore_actual) OVER (PARTITION BY year(gameDate)) AS am
      FROM {own_day} WHERE homeTeamScore_actual IS NOT NULL AND awayTeamScore_actual IS NOT NULL) GROUP BY y""",
        "snapshots",
    )

    # Outcomes over scenarios.
    seeds = ("div_1", "div_2", "div_3", "wc_1", "wc_2", "missed")
    stages = {"make_round_2": 1, "make_round_3": 2, "make_cup_final": 3, "win_cup": 4}
    count_of = {s: f"count(*) FILTER (playoffSeed = '{s}')" for s in seeds}
    count_of |= {s: f"count(*) FILTER (roundsWon >= {k})" for s, k in stages.items()}
    total = "(SELECT count(DISTINCT iteration) FROM outcomes)"

    def tally(names: tuple[str, ...], source: str, raw: bool = True) -> str:
        picks = [f"{count_of[n]} AS {n}" for n in names] if raw else []
        picks += [f'round({count_of[n]} * 100.0 / {total}, 6) AS "{n}_%"' for n in names]
        if "missed" in names:
            picks.append(f'round(({total} - {count_of["missed"]}) * 100.0 / {total}, 6) AS "playoff_%"')
        return f"SELECT teamName, {', '.join(picks)} FROM {source} GROUP BY teamName"

    league = "(SELECT t.teamName, o.playoffSeed, o.roundsWon FROM teams t LEFT JOIN outcomes o ON o.teamName = t.teamName)"
    everything = (*seeds, *stages)
    add("seed_probabilities", tally(seeds, league), "outcomes", "teams")
    add("round_probabilities", tally(tuple(stages), league), "outcomes", "teams")
    add("outcome_probabilities", tally(everything, "outcomes"), "outcomes")
    add("probability_report", tally(seeds, league, raw=False), "outcomes", "teams")

    def rings(position: str) -> str:
        parts = [f"SELECT teamName, 'playoff_%' AS ring, ({total} - {count_of['missed']}) * 100.0 / {total} AS percent FROM outcomes GROUP BY teamName"]
        parts += [
            f"SELECT teamName, '{s}_%', {count_of[s]} * 100.0 / {total} FROM outcomes GROUP BY teamName" for s in stages
        ]
        return f"""SELECT *, sum(share) OVER (PARTITION BY ring ORDER BY {position} ROWS UNBOUNDED PRECEDING) * 360 AS endAngle
FROM (SELECT r.*, n.n_nationkey, percent / sum(percent) OVER (PARTITION BY ring) AS share
      FROM ({' UNION ALL '.join(parts)}) r JOIN nation n ON n.n_name = r.teamName)"""

    angles = "round(endAngle - share * 360, 4) AS startAngle, round(endAngle, 4) AS endAngle"
    add(
        "ring_shares",
        f"SELECT ring, teamName, round(percent, 6) AS percent, round(share, 6) AS share, {angles} FROM ({rings('teamName')})",
        "outcomes",
    )
    add("ring_shares_by_slot", f"SELECT ring, teamName, {angles} FROM ({rings('n_nationkey DESC')})", "outcomes")
    add(
        "alive_teams",
        f'SELECT teamName, "make_cup_final_%" FROM ({tally(everything, "outcomes")}) WHERE "make_cup_final_%" > 0',
        "outcomes",
    )
    add(
        "scenario_outcomes",
        f"""SELECT t.seasonName, t.teamName, t.playoffSeed, count(r.winner) AS roundsWon
FROM table1 t LEFT JOIN ({results}) r ON r.seasonName = t.seasonName AND r.winner = t.teamName
GROUP BY t.seasonName, t.teamName, t.playoffSeed""",
        "round1",
        "series",
    )
    add(
        "latest_run",
        """SELECT event_id, CAST(predDate AS VARCHAR) AS predDate, n FROM (
  SELECT *, max(n) OVER (PARTITION BY predDate) AS top FROM (
    SELECT event_id, CAST(ts AS DATE) AS predDate, event_id % 3 * 100 + 100 AS n FROM events)) WHERE n = top""",
    )

    # Sources, sinks, refresh.
    add(
        "read_games",
        """SELECT gameId, seasonName, gameType, CAST(startTimeUTC AS VARCHAR) AS startTimeUTC, venueTimezone, venue,
  awayTeamName, homeTeamName, awayTeamScore, homeTeamScore, lastPeriod FROM timed""",
        "timed",
    )
    flat = """SELECT gameId, seasonName, gameType, strftime(startTimeUTC, '%Y-%m-%dT%H:%M:%SZ') AS startTimeUTC, venueTimezone,
  venue, awayTeamName || ' Club' AS awayTeamName, homeTeamName || ' Club' AS homeTeamName,
  awayTeamScore, homeTeamScore, lastPeriod FROM timed WHERE gameId % 17 <> 0"""
    add("flatten_schedule", flat, "timed")
    add("read_schedule", flat, "timed")
    add(
        "load_landed",
        flat.replace("awayTeamScore, homeTeamScore", "awayTeamScore, CASE WHEN gameDate >= DATE '2000-06-01' THEN homeTeamScore + 1 ELSE homeTeamScore END AS homeTeamScore"),
        "timed",
    )
    add(
        "suspect_venues",
        f"""SELECT * FROM (
WITH v AS (
  SELECT venue, CASE WHEN venue = 'Arena FRANCE' THEN -60.0 ELSE venue_lat END AS lat, CASE WHEN venue = 'Arena FRANCE' THEN 179.0 ELSE venue_long END AS long
  FROM venues WHERE venue = 'Arena FRANCE' OR venue_lat IS NOT NULL AND venue_long IS NOT NULL),
p AS (SELECT v.*, homeTeamName, awayTeamName FROM games g JOIN v ON v.venue = g.venue),
m AS (SELECT awayTeamName AS team, median(lat) AS m_lat, median(long) AS m_long FROM p GROUP BY team),
h AS (
  SELECT venue, lat AS v_lat, long AS v_long, homeTeamName, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, homeTeamName) AS r
  FROM p GROUP BY venue, lat, long, homeTeamName),
d AS (SELECT venue, homeTeamName, {_km('h.v_', 'm.m_')} AS km FROM h JOIN m ON m.team = h.homeTeamName WHERE r = 1),
o AS (SELECT *, km - (SELECT median(km) FROM d) AS off FROM d)
SELECT venue, homeTeamName, round(km, 6) AS distance_km, off > 3 * (SELECT median(abs(off)) FROM o) AS suspect FROM o)""",
        "games",
        "venues",
    )
    add(
        "changed_seasons",
        "SELECT seasonName, count(*) AS rows FROM games WHERE seasonName = '19961997' GROUP BY seasonName",
        "games",
    )
    add(
        "upsert_stored",
        """SELECT CASE WHEN gameId % 5 <> 0 THEN gameId END AS gameId, seasonName, homeTeamName,
  CASE WHEN gameDate >= DATE '2000-06-01' THEN homeTeamScore + 1 ELSE homeTeamScore END AS homeTeamScore
FROM (SELECT *, count(*) OVER (PARTITION BY gameDate, homeTeamName, awayTeamName) AS same FROM games WHERE gameId % 3 <> 0) WHERE same = 1""",
        "games",
    )
    for name in ("seed_from_sequences", "read_standings"):
        add(
            name,
            """SELECT teamName, conferenceName, divisionName, CAST(totalPoints AS DOUBLE) AS totalPoints, playoffSeed FROM table1""",
            "table1",
        )
    add(
        "season_label",
        """SELECT concat(CAST(y AS VARCHAR), CAST(y + 1 AS VARCHAR)) AS season, count(*) AS games
FROM (SELECT year(gameDate) - CASE WHEN month(gameDate) <= 6 THEN 1 ELSE 0 END AS y FROM games) GROUP BY y""",
        "games",
    )
    add("team_dim", "SELECT teamName, conferenceName, divisionName FROM teams", "teams")
    add(
        "resolve_venues",
        """SELECT g.venue,
  CASE WHEN v.venue_lat IS NOT NULL THEN v.venue_lat WHEN n.n_nationkey % 2 = 1 THEN CAST(n.n_nationkey AS DOUBLE) END AS venue_lat,
  CASE WHEN v.venue_lat IS NOT NULL THEN v.venue_long WHEN n.n_nationkey % 2 = 1 THEN CAST(-n.n_nationkey AS DOUBLE) END AS venue_long
FROM (SELECT DISTINCT venue FROM games) g LEFT JOIN venues v ON v.venue = g.venue
LEFT JOIN nation n ON concat('Arena ', n.n_name) = g.venue""",
        "games",
        "venues",
    )
    add(
        "upsert_games",
        """SELECT gameId, seasonName,
  CASE WHEN gameDate >= DATE '2000-06-01' THEN homeTeamScore + 1 ELSE homeTeamScore END AS homeTeamScore FROM games""",
        "games",
    )
    add(
        "replace_tail",
        """SELECT gameId, seasonName, homeTeamScore FROM timed WHERE seasonName = (SELECT max(seasonName) FROM games)
  AND CAST(startTimeUTC - INTERVAL 5 HOUR AS DATE) < DATE '2001-04-30'
UNION ALL SELECT gameId, seasonName, homeTeamScore + 1 FROM timed WHERE gameDate >= DATE '2001-04-30'""",
        "timed",
    )
    add(
        "missing_days",
        """SELECT seasonName, CAST(day AS VARCHAR) AS missingDate FROM (
  SELECT seasonName, CAST(unnest(generate_series(CAST(left(seasonName, 4) || '-09-23' AS TIMESTAMP),
    CAST(right(seasonName, 4) || '-06-30' AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM (SELECT DISTINCT seasonName FROM games)) c
WHERE NOT EXISTS (SELECT 1 FROM games g WHERE g.seasonName = c.seasonName AND g.gameDate = c.day)""",
        "games",
    )
    add(
        "seasons_to_refresh",
        """SELECT seasonName, complete, seasonName = top AS latest FROM (
  SELECT seasonName, bool_and(lastPeriod IS NOT NULL OR gameDate < DATE '1999-01-01') AS complete,
    (SELECT max(seasonName) FROM games) AS top FROM games GROUP BY seasonName)
WHERE NOT (complete AND seasonName <> top AND CAST(left(seasonName, 4) AS INT) % 2 = 0)""",
        "games",
    )
    masked = ", ".join(
        f"CASE WHEN startTimeUTC < TIMESTAMP '1998-03-15 05:00:00' THEN {c} END AS {c}"
        for c in ("homeTeamScore", "awayTeamScore", "lastPeriod")
    )
    add("mask_as_of", f"SELECT gameId, {masked} FROM timed", "timed")
    add(
        "next_open_date",
        """SELECT seasonName, CAST(min(gameDate) FILTER (lastPeriod IS NULL AND gameType = 2) AS VARCHAR) AS nextOpenDate,
  CAST(max(gameDate) FILTER (awayTeamScore IS NOT NULL) AS VARCHAR) AS lastPlayedDate FROM games GROUP BY seasonName""",
        "games",
    )
    add("open_dates", "SELECT DISTINCT CAST(gameDate AS VARCHAR) AS gameDate FROM games WHERE awayTeamScore IS NULL", "games")
    add(
        "staleness",
        """SELECT seasonName, CAST(first AS VARCHAR) AS firstUnplayed, coalesce(DATE '1998-06-01' > first, FALSE) AS stale,
  CAST(greatest(date_diff('day', first, DATE '1998-06-01'), 0) AS INT) AS daysBehind
FROM (SELECT seasonName, min(CAST(startTimeUTC - INTERVAL 5 HOUR AS DATE)) FILTER (lastPeriod IS NULL) AS first
      FROM timed GROUP BY seasonName)""",
        "timed",
    )
    add("current_season", "SELECT gameId, seasonName FROM games WHERE seasonName = (SELECT max(seasonName) FROM games)", "games")
    add(
        "week_bounds",
        """SELECT seasonName, homeTeamName, CAST(CAST(a - CAST(isodow(a) - 1 AS INT) AS DATE) AS VARCHAR) AS firstMonday,
  CAST(CAST(b + CAST(8 - isodow(b) AS INT) AS DATE) AS VARCHAR) AS lastMonday
FROM (SELECT seasonName, homeTeamName, min(gameDate) AS a, max(gameDate) AS b FROM games GROUP BY ALL)""",
        "games",
    )
    add(
        "local_time",
        """SELECT event_id, CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS gameDate,
  CAST(hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts) AS INT) AS gameTimeEST FROM events""",
    )
    # Daylight saving in these years: first Sunday of April to last Sunday of October, 2 am local time.
    add(
        "local_time_games",
        """SELECT gameId, CAST(CAST(local AS DATE) AS VARCHAR) AS gameDate,
  CAST(hour(local) * 60 + minute(local) AS INT) AS gameTimeEST,
  CAST(hour(fixed) * 60 + minute(fixed) AS INT) AS fixedMinute
FROM (SELECT gameId, fixed, CASE WHEN fixed >= april + (7 - isodow(april)) * INTERVAL 1 DAY + INTERVAL 2 HOUR
        AND fixed < october - (isodow(october) % 7) * INTERVAL 1 DAY + INTERVAL 1 HOUR
      THEN fixed + INTERVAL 1 HOUR ELSE fixed END AS local
      FROM (SELECT gameId, startTimeUTC - INTERVAL 5 HOUR AS fixed,
              make_timestamp(year(startTimeUTC), 4, 1, 0, 0, 0) AS april,
              make_timestamp(year(startTimeUTC), 10, 31, 0, 0, 0) AS october FROM timed))""",
        "timed",
    )
    add(
        "write_back",
        """SELECT gameId, CASE WHEN lastPeriod IS NULL AND gameType = 2 THEN 10.0 ELSE homeTeamScore END AS homeTeamScore,
  CASE WHEN lastPeriod IS NULL AND gameType = 3 THEN 20.0 ELSE awayTeamScore END AS awayTeamScore FROM games""",
        "games",
    )
    add("write_by_season", "SELECT gameId, seasonName, homeTeamName, homeTeamScore FROM games", "games")
    add(
        "write_snapshot",
        """SELECT gameId, homeTeamScore, '2001-08-01' AS predDate, 'playoff' AS kind FROM games
UNION ALL SELECT gameId, homeTeamScore, '2001-08-02', 'regularseason' FROM games WHERE gameType = 2""",
        "games",
    )

    # Model.
    codes = ", ".join(
        f"CAST((SELECT count(DISTINCT {c}) FROM games o WHERE o.{c} < g.{c} OR g.{c} IS NULL) AS INT) AS {c}Code"
        for c in ("homeTeamName", "venue", "lastPeriod")
    )
    add("encode_columns", f"SELECT gameId, {codes} FROM games g", "games")
    add(
        "call_period",
        """SELECT gameId, CASE WHEN h = a THEN h + 0.5 ELSE h END AS homeTeamScore, a AS awayTeamScore,
  CASE WHEN abs(h - a) < 0.25 THEN 'OT' ELSE 'REG' END AS lastPeriod
FROM (SELECT gameId, CAST(gameId % 50 AS DOUBLE) / 10 AS h, CAST(gameId * 7 % 50 AS DOUBLE) / 10 AS a FROM games)""",
        "games",
    )

    # Forecasts by the mean of the played games.
    played = "homeTeamScore IS NOT NULL AND awayTeamScore IS NOT NULL"
    means = f"(SELECT avg(homeTeamScore) AS h, avg(awayTeamScore) AS a FROM games WHERE {played})"
    add(
        "train_scores_mean",
        f"""SELECT gameId, round(h, 6) AS homeTeamScore_predicted, round(a, 6) AS awayTeamScore_predicted
FROM games CROSS JOIN {means}""",
        "games",
    )
    add(
        "model_round_trip",
        f"""SELECT gameId, round(h, 6) AS homeTeamScore_predicted, round(a, 6) AS awayTeamScore_predicted
FROM games CROSS JOIN {means}""",
        "games",
    )
    add(
        "score_games_mean",
        f"""SELECT gameId,
  round(CASE WHEN o THEN CASE WHEN h = a THEN h + 0.5 ELSE h END ELSE homeTeamScore END, 6) AS homeTeamScore,
  round(CASE WHEN o THEN a ELSE awayTeamScore END, 6) AS awayTeamScore,
  CASE WHEN NOT o THEN lastPeriod WHEN abs(h - a) < 0.25 THEN 'OT' ELSE 'REG' END AS lastPeriod
FROM (SELECT *, homeTeamScore IS NULL OR lastPeriod IS NULL AS o FROM games) CROSS JOIN {means}""",
        "games",
    )
    add(
        "holdout_metrics_mean",
        f"""SELECT count(*) AS games, round((avg((homeTeamScore - h) ** 2) + avg((awayTeamScore - a) ** 2)) / 2, 6) AS mse,
  round((1 - avg((homeTeamScore - h) ** 2) / var_pop(homeTeamScore) + 1 - avg((awayTeamScore - a) ** 2) / var_pop(awayTeamScore)) / 2, 6) AS r2,
  round(avg(CASE WHEN sign(homeTeamScore - awayTeamScore) = sign(h - a) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM games CROSS JOIN (SELECT avg(homeTeamScore) AS h, avg(awayTeamScore) AS a FROM games WHERE {played} AND seasonName <> '20002001')
WHERE {played} AND seasonName = '20002001'""",
        "games",
    )

    # Samples of the trees of a forest, and what trees of no depth vote for the games they haven't seen.
    h = f"gameId % {(1 << 31) - 1}"
    for step, (by, shift) in enumerate(forest.ROUNDS):
        h = f"(SELECT xor(h, h >> {shift}) FROM (SELECT ({h} * {by} + tree * 7919 + {42 + step}) % {(1 << 31) - 1} AS h))"
    steps = " + ".join(f"CAST(h >= {limit} AS INT)" for limit in forest.LIMITS)

    def samples(n: int) -> str:
        return f"SELECT *, {steps} AS weight FROM (SELECT g.*, tree, {h} AS h FROM games g, range({n}) AS r(tree))"

    add("bootstrap_weights", f"SELECT gameId, CAST(tree AS INT) AS tree, CAST(weight AS INT) AS weight FROM ({samples(5)})", "games")
    add(
        "oob_metrics_mean",
        f"""SELECT count(h) AS games, round((avg((homeTeamScore - h) ** 2) + avg((awayTeamScore - a) ** 2)) / 2, 6) AS mse,
  round((1 - avg((homeTeamScore - h) ** 2) / var_pop(homeTeamScore) FILTER (h IS NOT NULL)
    + 1 - avg((awayTeamScore - a) ** 2) / var_pop(awayTeamScore) FILTER (h IS NOT NULL)) / 2, 6) AS r2,
  round(avg(CASE WHEN h IS NULL THEN NULL WHEN sign(homeTeamScore - awayTeamScore) = sign(h - a) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) - count(h) AS unvoted
FROM (SELECT gameId, homeTeamScore, awayTeamScore, avg(CASE WHEN weight = 0 THEN h END) AS h, avg(CASE WHEN weight = 0 THEN a END) AS a
  FROM (SELECT gameId, homeTeamScore, awayTeamScore, weight,
      sum(weight * homeTeamScore) OVER t / sum(weight) OVER t AS h, sum(weight * awayTeamScore) OVER t / sum(weight) OVER t AS a
    FROM ({samples(20)}) WHERE {played} WINDOW t AS (PARTITION BY tree)) GROUP BY ALL)""",
        "games",
    )

    # Landed files read back.
    add("read_teams", "SELECT teamName, conferenceName, divisionName FROM teams", "teams")
    add("read_venues", "SELECT venue, venue_lat, venue_long FROM venues", "venues")
    add(
        "read_odds",
        "SELECT gameId, CASE WHEN gameId % 7 = 0 THEN NULL ELSE homeTeamOdds END AS homeTeamOdds, awayTeamOdds FROM odds",
        "odds",
    )
    return sql
