"""siftlane: message-risk analytics and corpus preparation, declared as Spark plans."""
