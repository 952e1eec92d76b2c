"""riskloom: Spark-native operators for behaviour-log features and scores."""
