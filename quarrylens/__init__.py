"""quarrylens: operational and quality analytics as DataFrame-to-DataFrame operators on Spark."""
