"""Plan building blocks that keep work distributed, and the composed runs."""
