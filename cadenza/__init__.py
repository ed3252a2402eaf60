"""cadenza: a Spark-native engine for analysing a music catalog and the people who listen to it."""
