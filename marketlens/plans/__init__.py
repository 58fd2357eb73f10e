"""The analyses and marts: functions from ``Tables`` to one lazy DataFrame."""
