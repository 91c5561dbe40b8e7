"""rolloutlens: rollout analytics on Spark.

Tables of problems, sampled completions, token log-probabilities and run
logs go in; prompts, answers, rewards, group advantages, majority votes,
budgeted training records, token-loss statistics and metric series come
out. Every operator is a DataFrame / SQL / window / higher-order-function
plan, so Catalyst and AQE choose the physical strategy.
"""

__version__ = "0.1.0"
