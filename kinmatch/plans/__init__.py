"""End-to-end plans: training, inference, and the registered queries."""
