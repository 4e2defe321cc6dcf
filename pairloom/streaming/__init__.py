"""There are no streaming operators: evaluation is a batch job here. Components of pairs (operators.bleu) are plain rows, so a
stream of pairs can be turned into them and summed by any Structured Streaming aggregation."""
