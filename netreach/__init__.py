"""Site-network planning and mobility-risk analytics as Spark DataFrame operators."""
