"""sweepframe: analytics over rotating-scanner telemetry, as plain DataFrame functions on Spark."""
