"""Small frames for hand-made cases."""

from datetime import date

GAME = (
    "gameId long, seasonName string, gameType int, gameDate date, gameTimeEST int, venue string, "
    "homeTeamName string, awayTeamName string, homeTeamScore double, awayTeamScore double, lastPeriod string"
)


def game(gid, day, home, away, hs=None, as_=None, period="REG", kind=2, venue=None, season="20242025", minute=1140):
    """One game; without scores it is unplayed and has no period."""
    if hs is None:
        period = None
    day = date.fromisoformat(day) if day else None
    score = (float(hs), float(as_)) if hs is not None else (None, None)
    return (gid, season, kind, day, minute, venue or f"{home} Hall", home, away, *score, period)


def log(spark, *games):
    return spark.createDataFrame(list(games), GAME)


def by_id(df, key="gameId"):
    return {row[key]: row for row in df.collect()}
